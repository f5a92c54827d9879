"""Words, patterns and constants that decide results.

Everything here is data that has to hold exactly these values for the results
to be right.  It is kept in one place, as plain text, in its natural order, and
the order of the lists matters wherever the first match wins.
"""

# --- fixed values: numbers in print ---------------------------------------

CURRENCY_CODES = (
    "EUR", "USD", "GBP", "CHF", "PLN", "SEK", "NOK", "DKK", "CZK", "HUF", "RON", "BGN", "HRK",
)
CURRENCY_SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP"}
LARGEST_AMOUNT = 1e9

# --- fixed values: keywords of the languages --------------------------------

LANGUAGE_WORDS = {
    "de": (
        "rechnung", "zwischensumme", "gesamtbetrag", "mehrwertsteuer", "mwst", "mws", "ust",
        "rechnungsdatum", "fällig", "fälligkeit", "zahlbar", "netto", "brutto", "einzelpreis",
        "menge", "beschreibung", "rechnungsnummer",
    ),
    "en": (
        "invoice", "subtotal", "total", "vat", "quantity", "unit price", "description",
        "amount due", "due date", "net", "gross", "invoice number",
    ),
    "fr": (
        "facture", "sous-total", "total", "tva", "quantité", "prix unitaire", "description",
        "échéance", "net", "brut", "montant", "numéro de facture",
    ),
    "it": (
        "fattura", "importo", "iva", "quantità", "prezzo unitario", "descrizione", "totale",
        "netto", "scadenza", "numero fattura",
    ),
    "es": (
        "factura", "total", "iva", "cantidad", "precio unitario", "descripción", "base imponible",
        "importe", "neto", "bruto", "número de factura",
    ),
    "nl": (
        "factuur", "subtotaal", "totaal", "btw", "aantal", "eenheidsprijs", "omschrijving",
        "netto", "bruto", "vervaldatum", "factuurnummer",
    ),
}
LANGUAGE_CONFIDENCE_CAP = 0.95
LANGUAGE_CONFIDENCE_BASE = 0.5
LANGUAGE_CONFIDENCE_STEP = 0.1

# --- fixed values: keywords of the document types ---------------------------
# "kontoauszug" stands twice and counts twice.

DOCUMENT_TYPE_WORDS = {
    "invoice": (
        "rechnung", "invoice", "faktura", "facture", "fattura", "factuur", "fatura",
        "rechnungsnummer", "invoice number", "invoice date", "rechnungsdatum", "zahlungsziel",
        "payment terms", "due date", "fällig am",
    ),
    "receipt": (
        "receipt", "quittung", "kassenbeleg", "bon", "till receipt", "point of sale", "pos",
        "cashier", "belegnummer", "zahlungsbeleg", "payment receipt",
    ),
    "purchase_order": (
        "purchase order", "bestellung", "bestellnummer", "po number", "purchase order number",
        "bestelldatum", "order date", "Lieferant", "vendor", "buyer", "besteller",
    ),
    "proforma": (
        "proforma", "pro-forma", "pro forma", "vorabrechnung", "provisional invoice", "angebot",
        "angebotsnummer", "offer", "quotation", "angebotstyp",
    ),
    "credit_note": (
        "credit note", "gutschrift", "creditmemo", "credit memo", "storno", "rückerstattung",
        "refund", "gutschriftenummer", "credit number", "gutscher",
    ),
    "contract": (
        "contract", "vertrag", "vereinbarung", "agreement", "dienstleistungsvertrag",
        "werkvertrag", "kaufvertrag", "mietvertrag", "lease", "partnerschaft", "partnership",
        "bedingungen", "conditions", "clause", "klausel", "unterschrift", "signature",
        "unterzeichnet",
    ),
    "shipping_document": (
        "shipping", "lieferschein", "delivery note", "packlist", "packing list", "frachtbrief",
        "waybill", "consignment", "tracking", "versand", "shipment", "logistics", "carrier",
        "spedition", "transport", "container",
    ),
    "customs_form": (
        "customs", "zoll", "declaration", "zollerklärung", "customs declaration", "cn22", "cn23",
        "formular", "export", "import", "zollamt", " customs ", "declaration number",
        "zollnummer",
    ),
    "bank_statement": (
        "bank statement", "kontoauszug", "kontoumsatz", "kontobewegung", "bankauszug",
        "girokonto", "kontoauszug", "umsatz", "saldo", "buchung", "transaction", "transaktion",
        "kontonummer", "bankleitzahl", "blz",
    ),
    "tax_document": (
        "tax", "steuer", "steuererklärung", "tax return", "steuerbescheid",
        "steueridentifikationsnummer", "tax id", "tin", "steuerpflicht", "vat return",
        "gewinnermittlung", "jahresabschluss",
    ),
    "employee_document": (
        "employee", "mitarbeiter", "angestellte", "lohn", "gehalt", "payroll",
        "personalausweis", "arbeitsvertrag", "beschäftigung", "employment", "jahreslohn",
    ),
    "insurance_claim": (
        "insurance", "versicherung", "schadenmeldung", "claim", "versicherungsschein", "police",
        "deckung", "versicherungnehmer", "versicherunggeber",
    ),
    "land_registry": (
        "grundbuch", "land register", "grundbucheintrag", "grunddaten", "liegenschaft",
        "immobilie", "property register",
    ),
    "court_order": (
        "gericht", "court", "beschluss", "urteil", "verfügung", "gerichtsbeschluss", "lawsuit",
        "prozess", "klage",
    ),
    "financial_report": (
        "financial report", "finanzbericht", "jahresbericht", "geschäftsbericht",
        "financial statement", "report", "bericht", "analyse", "analysebericht",
    ),
    "balance_sheet": (
        "balance sheet", "bilanz", "vermögensübersicht", "aktiva", "passiva", "bilanzkonto",
        "bilanzstamm",
    ),
    "income_statement": (
        "income statement", "gewinn- und verlustrechnung", "guv", "erfolgsrechnung", "gewinn",
        "verlust", "ertrag", "aufwand", "gewinnmarge",
    ),
}
UNKNOWN_DOCUMENT_TYPE = "unknown"

# --- fixed values: words that steer the field finders -----------------------

NUMBER_WORDS = ("invoice", "rechnung", "faktura", "facture", "fattura", "factuur", "fatura")
NUMBER_MARKS = ("nr\\.?", "no\\.?", "nummer", "number", "n°", "n")

DUE_WORDS = (
    "due", "fällig", "fälligkeit", "scadenza", "echeance", "échéance", "vencimiento",
    "vervaldatum", "vervaldag", "betaaldatum", "zahlbar", "payment date",
)

# Words that may stand inside other words, then words that must stand alone.
SUBTOTAL_WORDS = (
    "subtotal", "zwischensumme", "sous-total", "subtotaal", "total net", "net total",
    "base imponible", "importo imponibile", "totaal netto",
)
SUBTOTAL_WHOLE_WORDS = ("netto",)
TAX_WORDS = (
    "mehrwertsteuer", "umsatzsteuer", "mwst", "mws", "omzetbelasting", "taxe", "imposta",
    "impuesto",
)
TAX_WHOLE_WORDS = ("ust", "vat", "tva", "iva", "btw", "tax")
TOTAL_WORDS = (
    "rechnungsbetrag", "endbetrag", "gesamtbetrag", "gesamt", "grand total", "amount due",
    "total a payer", "total à payer", "totaalbedrag", "totaal te betalen", "importo totale",
    "montant total", "montant", "betrag", "summe",
)
TOTAL_WHOLE_WORDS = ("totale", "total")

NOT_A_SUPPLIER_WORDS = (
    "rechnung", "invoice", "faktura", "facture", "fattura", "factuur", "fatura", "gutschrift",
    "angebot", "bestellung", "auftrag", "order", "offer", "credit note", "pos", "beschreibung",
    "description", "menge", "quantity", "einzelpreis", "unit price", "netto", "brutto", "mwst",
    "vat", "total", "summe", "betrag", "mit freundlichen",
)
SUPPLIER_MIN_WORDS = 2
SUPPLIER_MAX_DIGITS = 6
SUPPLIER_MAX_TOP = 0.6
SUPPLIER_MAX_LEFT = 0.4

# --- fixed values: words of table headers, in the order they are tried ------

COLUMN_WORDS = {
    "description": (
        "beschreibung", "description", "bezeichnung", "article", "artikel", "product",
    ),
    "quantity": (
        "menge", "quantity", "qty", "anzahl", "quantità", "cantidad", "hoeveelheid",
    ),
    "unit_price": (
        "einzelpreis", "unit price", "unitprice", "unit cost", "prix unitaire",
        "prezzo unitario",
    ),
    "vat_rate": ("vat", "mwst", "mws", "ust", "tva", "iva", "btw", "tax"),
    "net": ("netto", "net total", "total net", "montant ht", "base imponible", "imponibile"),
    "gross": ("brutto", "bruto", "gross", "montant ttc", "total ttc"),
    "vat_amount": (
        "vat", "mwst", "mws", "ust", "tva", "iva", "btw", "tax", "imposta", "impuesto",
    ),
    "position": ("pos", "position", "nr", "lfd", "item no"),
}
TOTAL_ROW_WORDS = ("gesamt", "total", "summe", "betrag", "brutto", "netto", "zwischensumme")

# --- fixed values: types of requested fields, in the order they are tried ---

FIELD_TYPES = ("string", "number", "date", "currency", "boolean", "array", "object")
FIELD_TYPE_WORDS = {
    "date": ("date", "time", "when", "deadline", "start", "end"),
    "currency": (
        "amount", "price", "total", "sum", "cost", "fee", "vat", "tax", "discount", "net",
        "gross", "money", "eur", "usd", "gbp",
    ),
    "number": ("count", "quantity", "num", "number of", "qty"),
    "boolean": ("is ", "has ", "includes ", "contains ", "bool", "yes/no", "true/false"),
    "array": ("items", "line", "list", "every", "all ", "each "),
}

# --- fixed values: account numbers and tax identifiers ----------------------

IBAN_LENGTHS = {
    "DE": 22, "IT": 27, "FR": 27, "ES": 24, "NL": 18, "BE": 16, "AT": 20, "LU": 20, "PT": 25,
    "IE": 22,
}
VAT_SHAPES = {
    "DE": "DE[0-9]{9}",
    "IT": "IT[0-9]{11}",
    "FR": "FR[A-Z0-9]{2}[0-9]{9}",
    "ES": "ES[A-Z0-9][0-9]{7}[A-Z0-9]",
    "NL": "NL[0-9]{9}B[0-9]{2}",
    "BE": "BE[0-9]{10}",
    "AT": "ATU[0-9]{8}",
    "LU": "LU[0-9]{8}",
    "PT": "PT[0-9]{9}",
    "IE": "IE[A-Z0-9][0-9]{5}[A-Z0-9]{2,3}",
}

# --- fixed values: tolerances of the checks ---------------------------------

LINE_GROSS_TOLERANCE = "0.01"
SUBTOTAL_TOLERANCE = "0"
VAT_TOTAL_TOLERANCE = "0.02"
GRAND_TOTAL_TOLERANCE = "0.02"

# field of the document -> check that decides about it
CHECK_OF_FIELD = {
    "subtotal": "subtotal",
    "total_vat": "vat_total",
    "total": "grand_total",
    "supplier_vat": "vat_format",
    "iban": "iban",
}

# --- fixed values: confidence -----------------------------------------------

MONEY_FIELDS = ("subtotal", "total_vat", "total", "shipping", "other")
DATE_FIELDS = ("invoice_date", "due_date")
IDENTITY_FIELDS = (
    "supplier_name", "supplier_vat", "iban", "bic", "vat_number", "invoice_number",
)
# method, reading, consistency, validator
CONFIDENCE_WEIGHTS = {
    "money": (0.45, 0.25, 0.15, 0.15),
    "identity": (0.40, 0.30, 0.15, 0.15),
    "text": (0.35, 0.35, 0.10, 0.20),
}
VALIDATOR_FACTORS = {"pass": 1.0, "warn": 0.7, "fail": 0.0}
VALIDATOR_FACTOR_OTHERWISE = 0.8
FAILED_MONEY_FACTOR = 0.2
METHOD_CONFIDENCE_OTHERWISE = 0.5
THRESHOLD_OTHERWISE = 0.85

RULE_CONFIDENCE = {
    "supplier_vat": 0.98,
    "iban": 0.98,
    "invoice_number": 0.85,
    "invoice_date": 0.9,
    "due_date": 0.9,
    "currency": 0.9,
    "subtotal": 0.9,
    "total_vat": 0.9,
    "total": 0.9,
    "supplier_name": 0.6,
}
LINE_CONFIDENCE = 0.85
LINE_CONFIDENCE_NO_TEXT = 0.6

# --- fixed values: model answers --------------------------------------------

GROUNDED_CONFIDENCE = 0.85
UNGROUNDED_CONFIDENCE = 0.6
AGREEMENT_BONUS = 0.05
CONFLICT_MALUS = 0.1
MERGE_MONEY_TOLERANCE = 0.02
MERGE_RELATIVE_TOLERANCE = 1e-9
CONFLICT_RULE = "RULE_LLM_DISAGREE"
WELL_FORMED_FIELDS = (
    "supplier_vat", "iban", "invoice_number", "invoice_date", "due_date", "currency",
    "subtotal", "total_vat", "total", "shipping", "other",
)
MOST_ATTEMPTS = 2

# (policy, task) -> route; alternatives of one route are joined by a pipe
ROUTES = {
    ("eu_only", "extract"): "mistral:medium",
    ("eu_only", "classify"): "mistral:small",
    ("eu_only", "vlm"): "mistral:pixtral",
    ("us_opt_in", "extract"): "openai:gpt-4o-mini|anthropic:claude-haiku",
    ("us_opt_in", "vlm"): "gemini:2.5-flash",
    ("sovereign", "extract"): "local:qwen2.5-7b",
    ("sovereign", "vlm"): "local:qwen2.5-vl-3b",
}
DEFAULT_POLICY = "eu_only"
ROUTE_OTHERWISE = "mistral:small"
# price of a thousand tokens
TOKEN_PRICES = {
    "mistral:small": 0.0002,
    "mistral:medium": 0.002,
    "mistral:pixtral": 0.004,
    "openai:gpt-4o-mini": 0.00015,
    "anthropic:claude-haiku": 0.00025,
    "gemini:2.5-flash": 0.0001,
}
TOKEN_PRICE_OTHERWISE = 0.001

# --- fixed values: pages and files ------------------------------------------

LINE_TOLERANCE = 3.0
MIN_READING_SCORE = 0.5
UPLOAD_SUFFIXES = (
    "pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "heic", "zip",
)
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "heic")
MOST_UPLOAD_BYTES = 20 * 1024 * 1024
MOST_FILES_PER_BATCH = 100
NO_TEXT_ERROR = "OCR_NO_TEXT"

# --- fixed values: search ---------------------------------------------------

OVER_WORDS = ("over", "above", "more than", "greater than", ">=", ">")
UNDER_WORDS = ("under", "below", "less than", "<=", "<")
AFTER_WORDS = ("after", "from", "since", "starting")
BEFORE_WORDS = ("before", "until", "through", "ending", "to")
PLACE_WORDS = ("from", "in", "based in", "located in")
STATE_WORDS = ("status", "state")
STATE_VERBS = ("is", "are", "was", "were")
ASK_WORDS = ("find", "show", "get", "list")
TRUST_WORDS = ("high confidence", "confident", "reliable")
TRUST_CONFIDENCE = 0.8
# spoken name -> document type, in the order they are tried
SEARCH_TYPES = {
    "invoice": "invoice",
    "receipt": "receipt",
    "po": "purchase_order",
    "purchase order": "purchase_order",
    "contract": "contract",
    "shipping": "shipping_document",
    "customs": "customs_form",
    "bank statement": "bank_statement",
    "tax document": "tax_document",
    "report": "financial_report",
}
SEARCH_STOP_WORDS = (
    "over", "above", "more than", "greater than", "under", "below", "less than", "after",
    "from", "since", "starting", "before", "until", "through", "ending", "to", "is", "are",
    "was", "were", "find", "show", "get", "list", "every", "all",
)
SEARCH_STOP_STARTS = ("€", "$", "£", ">", "<")
SEARCH_LIMIT = 100
LISTING_LIMIT = 100

# Which date a failed rule is about, which field a duplicate is found by.
DATE_OF_CHECK = {"date_not_ahead": "invoice_date", "date_in_range": "invoice_date", "due_after_date": "due_date"}
FIELD_OF_DUPLICATE = {"number": "invoice_number", "total": "total"}
# Signs and codes of currencies in print.
CURRENCY_TOKEN = "[A-Za-z]+|[€$£]"
CURRENCY_MARKS = {"€": "EUR", "$": "USD", "£": "GBP", "EUR": "EUR", "USD": "USD", "GBP": "GBP", "CHF": "CHF"}
# Roles that see personal fields in full.
TRUSTED_ROLES = ("owner", "admin", "member")
PERSONAL_FIELDS = ("supplier_name", "iban")
# Classes of seeded mistakes and the checks that are to find them.
MISTAKES = ("drift", "vat_code", "iban_code", "swapped", "missing")
CHECKS_OF_MISTAKE = {"drift": ("subtotal",), "vat_code": ("vat_format",), "iban_code": ("iban",),
                     "swapped": ("subtotal", "grand_total"), "missing": ("missing_iban",)}
