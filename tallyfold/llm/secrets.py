"""Secret scans: fixed patterns, and windows of high entropy in long tokens. Spark functions only.

Base spans are the matches of three fixed patterns. The method adds spans: over every token of at
least `WINDOW` characters a window slides; its character counts change by the entering and the
leaving character, and with them the sum of c * log2(c), from which the Shannon entropy follows. Each
class of characters (hexadecimal, base64, letters only) has its own limit; the span reaches from the
first window at or above it to the end of the last. Tokens are the longest runs of base64 characters,
and besides those of hexadecimal digits, wherever they stand, so that no prefix changes the class;
an equals sign ends a token. Tokens on the allow-list add nothing, nor do spans within a base span.
Base spans always stay.

Cases: a null text counts as empty; an empty one has no spans; texts are read whole; places count
code points; a text with the same secret twice has two spans; repeated rows are scanned each; other
columns are not read.
"""

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. A run of hexadecimal digits or of capitals is taken as a whole, so
# the least length can stand in the pattern; of an assignment it is judged after matching.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED = 12

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
WINDOW = 20
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
HEX_TOKEN = r"(?<![0-9a-fA-F])[0-9a-fA-F]{20,}"
#: Entropy limits in bits a character; the most that a window of 20 can have is 4 and 4.32.
LIMITS = {"entropy_hex": 3.0, "entropy_base64": 3.7, "letters": 3.3}
#: Tokens of letters are words, unless two pairs of letters that words hardly have, or two small
#: letters alone among capitals, stand close together.
LETTERS = r"^[A-Za-z_/=+-]+$"
_RARE = (r"(?:[jq][b-df-hj-np-tv-z]|v[b-df-hj-kmnp-qtv-xz]|x[bdfgj-nrsvwxz]|hh|[bfghkmpwyz]q|[cfghkmpwyz]j|[bcdfghkmpwz]x"
         r"|[cpwy]v|c[bdfgmnpwz]|p[bcdgkmwz]|w[bcfgmpz]|[fgk]z|[hkg]c)")
UNLIKE_WORDS = (rf"(?i){_RARE}.{{0,40}}{_RARE}", r"[A-Z][a-z](?=[A-Z]).{0,12}[A-Z][a-z](?=[A-Z])")
#: Tokens that look random and are none: numbers and dates, identifiers of the UUID form, runs of one
#: or two characters, well-known samples.
ALLOWED = (
    r"^[0-9_/=+-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(.{1,2})\1+$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh",
)
SPAN = "struct<start:bigint,kind:int,end:bigint,word:string>"


def _matches(text: Column, pattern: str, code: int, value_length: int = 0) -> Column:
    """An array of the leftmost matches that do not overlap, as spans; short values are dropped."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if value_length else whole
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"),
                         whole.alias("whole"), value.alias("value"))

    def step(state, part):
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["whole"])
        span = F.struct(start.alias("start"), F.lit(code).alias("kind"), end.alias("end"), part["whole"].alias("word"))
        fine = F.length(part["value"]) >= value_length
        return F.struct(end.alias("at"), F.when(fine, F.concat(state["spans"], F.array(span))).otherwise(
            state["spans"]).alias("spans"))

    none = F.array().cast(f"array<{SPAN}>")
    walked = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step)
    return F.when(text.rlike(pattern), walked["spans"]).otherwise(none)


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _random_span(token: Column) -> Column:
    """The part of a token's span that windows at or above the entropy limit cover; null if there are none."""
    word = token["word"]
    hexadecimal = word.rlike("^[0-9a-fA-F]+$")
    limit = F.when(hexadecimal, LIMITS["entropy_hex"]).when(word.rlike(LETTERS), LIMITS["letters"]).otherwise(
        LIMITS["entropy_base64"])
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])

    def changed(state, code, by):
        """Counts and sum after `code` enters (1) or leaves (-1)."""
        counts, before = state["counts"], F.element_at(state["counts"], code + 1)
        return F.struct(
            F.transform(counts, lambda c, i: F.when(i == code, c + by).otherwise(c)).alias("counts"),
            (state["total"] + F.element_at(weights, before + by + 1) - F.element_at(weights, before + 1)).alias("total"),
            state["first"].alias("first"), state["last"].alias("last"))

    def slide(codes, state, place):
        code = F.element_at(codes, place)
        left = changed(state, F.element_at(codes, F.greatest(F.lit(1), place - WINDOW)), -1)
        left = F.when(place > WINDOW, left).otherwise(state)
        return _bound(left, lambda before: _bound(changed(before, code, 1), lambda now: judged(now, place)))

    def judged(now, place):
        high = (place >= WINDOW) & (F.lit(math.log2(WINDOW)) - now["total"] / WINDOW >= limit - F.lit(1e-9))
        return F.struct(
            now["counts"].alias("counts"), now["total"].alias("total"),
            F.when(high & (now["first"] < 0), place - WINDOW).otherwise(now["first"]).alias("first"),
            F.when(high, place).otherwise(now["last"]).alias("last"))

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"),
                     F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    codes = F.transform(F.split(word, ""), F.ascii)
    walked = _bound(codes, lambda c: F.aggregate(
        F.sequence(F.lit(1), F.size(c)), start, lambda state, place: slide(c, state, place),
        lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))
    kind = F.when(hexadecimal, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64"))

    def span(found):
        return F.when(found["first"] >= 0, F.struct(
            (token["start"] + found["first"]).alias("start"), kind.alias("kind"),
            (token["start"] + found["last"]).alias("end"), word.alias("word")))

    return _bound(walked, span)


def scan(docs: DataFrame, carried=("doc_id",)) -> DataFrame:
    """carried, text, base and spans (arrays of kind, start, end; by start, then kind) for every row of docs.

    carried is a structure of the named columns.
    """
    text = F.col("text")
    rows = docs.select(F.struct(*carried).alias("carried"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "carried", "text",
        F.array_sort(F.concat(_matches(text, ASSIGN, 0, ASSIGNED), _matches(text, ACCESS, 1), _matches(text, HEX, 2))).alias("base"),
        _matches(text, TOKEN, -1).alias("tokens"), _matches(text, HEX_TOKEN, -1).alias("hex_tokens"))
    # Those of hexadecimal digits only are among the others.
    tokens = F.concat(F.filter("tokens", lambda t: ~t["word"].rlike("^[0-9a-fA-F]+$")), "hex_tokens")

    def allowed(token):
        found = [token["word"].rlike(p) for p in ALLOWED]
        unlike = [token["word"].rlike(p) for p in UNLIKE_WORDS]
        words = token["word"].rlike(LETTERS) & ~functools.reduce(Column.__or__, unlike)
        return functools.reduce(Column.__or__, found, words)

    rows = rows.withColumn("tokens", F.filter(tokens, lambda t: ~allowed(t)))
    rows = rows.withColumn("more", F.filter(F.transform("tokens", _random_span), lambda s: s.isNotNull()))
    fresh = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", fresh)))
    names = F.array(*map(F.lit, KINDS))

    def named(spans):
        return F.transform(spans, lambda s: F.struct(
            F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return rows.select("carried", "text", named("base").alias("base"), named("spans").alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str, spans: str, mark: str = "[secret]") -> Column:
    """The text with every span, and any that overlap it, replaced by one mark."""
    def step(state, span):
        inside = span["start"] < state["at"]
        gap = F.substring(F.col(text), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], gap, F.lit(mark))).alias("out"))

    walked = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step)
    rest = F.substring(F.col(text), (walked["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(F.concat(walked["out"], rest))
