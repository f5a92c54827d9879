"""Collocations: phrases of two to four words that stand together more often than their parts would.

Words are the bytes between blanks and tabs within pieces, A to Z lower-cased; pieces end at . , ; : ! ?
and line ends. Counts are per language (null: `und`), over all documents.

1. Safe candidates, level by level (`frequent`). Words, then pairs, triples and quadruples travel as
   64-bit hashes, counted once within each task and added up by Spark. A phrase is looked at only if
   both phrases of one word less may be frequent, by a bitmap of a fixed size that holds the frequent
   hashes of the level before. Equal hashes of different phrases, and equal places in a bitmap, can only
   add, so no phrase of `least` occurrences is lost. The longest phrase at each position that may be frequent
   is then read off the texts; equal ones are added up, byte by byte (`windows`). They are not many more than
   the candidates, which are what they begin with, joined by the hash (`candidates`).
2. Exact counts (`counted`). The texts are not read again, however many candidates there are. Candidates and
   windows are split into shards by a hash of their first word, about SHARD candidates each. A task makes
   a double-array trie of a shard's candidates, whose size is bounded with it, holds one state per window and
   advances all of them by one word at a time, level by level; accepting states are binned and counted.
   Every occurrence of a candidate begins a window, since the bitmaps decide by the candidate's words alone.
3. Scores, containment and the best of each language are joins of the counted phrases (`mine`).

Cases: null and empty texts have no words; texts are read whole, in stretches that end between pieces;
repeated rows count again; words are compared byte by byte, not by hash, in step 2; ties are ordered by
score, count, then the phrase's bytes; languages without a phrase have no rows. Only the text and the
language are read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import tidied, written

LONGEST = 4
#: Bits of a bitmap, 4 MB whatever the corpus; phrases of a shard; bytes of text and hashes handled at once.
BITMAP, SHARD, STRETCH, HELD = 25, 100_000, 2 << 20, 4_000_000
#: Pieces in which a language's phrases are ranked first.
PIECES = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one; masks of the first 0 to 8 letters.
LONG_WORD = 256
_LETTERS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kinds = np.zeros(256, np.uint8)
    kinds[[9, 32]] = 1
    kinds[[10, 11, 12, 13, *b".,;:!?"]] = 2
    return lower, kinds


_LOWER, _KIND = _classes()


def stretches(batch):
    """The words of an Arrow batch (text, lang) in stretches of whole pieces.

    Yields (words, langs, lang_at, run): the word at each position, the distinct languages and each
    position's, and how many words, itself included, its piece still has, at most LONGEST.
    """
    texts = pc.fill_null(batch["text"].cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if offsets[-1] == offsets[0]:
        return
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
    ends = offsets[1:] - offsets[0]
    langs = batch["lang"].dictionary_encode()
    lang_of = langs.indices.to_numpy()
    start = 0
    while start < len(data):
        stop = min(start + STRETCH, len(data))
        document = int(ends[np.searchsorted(ends, stop)]) if stop < len(data) else len(data)
        while stop < document:
            found = np.flatnonzero(_KIND[data[stop:min(document, stop + STRETCH)]] == 2)
            if len(found):
                stop += int(found[0]) + 1
                break
            stop = min(document, stop + STRETCH)
        yield from _words(data[start:stop], ends - start, langs.dictionary, lang_of)
        start = stop


def _words(data, ends, langs, lang_of):
    kinds = _KIND[data]
    word = kinds == 0
    first = word.copy()
    first[1:] &= kinds[:-1] != 0
    inside = ends[(ends > 0) & (ends < len(data))]
    first[inside] = word[inside]
    begins = np.flatnonzero(first)
    if not len(begins):
        return
    # Words without what stands between them are one buffer, cut where words begin.
    letters = data[word]
    offsets = np.append(np.flatnonzero(first[word]), len(letters))
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    stops = np.clip(np.searchsorted(begins, ends), 0, len(begins))
    lang_at = np.repeat(lang_of, np.diff(stops, prepend=0))
    new = np.zeros(len(begins) + 1, bool)
    new[stops] = True
    new[np.searchsorted(begins, np.flatnonzero(kinds == 2))] = True
    borders = np.flatnonzero(new[1:]) + 1
    run = np.repeat(borders, np.diff(borders, prepend=0)) - np.arange(len(begins))
    yield words, langs, lang_at, np.minimum(run, LONGEST)


def _hashes(words, langs, lang_at) -> np.ndarray:
    """A hash of each position's word and language: eight letters of all words at a time."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)
    letters = np.append(np.frombuffer(words.buffers()[2], np.uint8), np.zeros(8, np.uint8))
    eights = np.ndarray(len(letters) - 7, "<u8", letters, strides=(1,))
    at, sizes = offsets[:-1].copy(), np.diff(offsets)
    long = np.flatnonzero(sizes > LONG_WORD)
    h = sizes.astype(np.uint64)
    live = np.flatnonzero(sizes <= LONG_WORD)
    while len(live):
        left = sizes[live]
        h[live] = _mixed(h[live] ^ (eights[at[live]] & _LETTERS[np.minimum(left, 8)]))
        at[live] += 8
        sizes[live] -= 8
        live = live[left > 8]
    for i in long:
        h[i] = xxhash.xxh64_intdigest(words[int(i)].as_py())
    by = np.array([xxhash.xxh64_intdigest(x, 1) for x in langs.to_pylist()], np.uint64)
    return _mixed(h ^ by[lang_at])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _may_be(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - BITMAP)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _levels(stretch, bitmaps: list):
    """Per level from 1 on, the positions whose phrase may be frequent and the hashes of the next level's phrases.

    Level k's phrase at a position stays if its bitmap has it; level k + 1's is asked about if both its parts stayed.
    """
    words, langs, lang_at, run = stretch
    single = _hashes(words, langs, lang_at)
    h, here = single, np.arange(len(single))
    yield here, h
    for k, bitmap in enumerate(bitmaps, 1):
        stays = np.zeros(len(single) + 1, bool)
        stays[here] = _may_be(bitmap, h)
        whole = np.zeros(len(single), np.uint64)
        whole[here] = h
        here = np.flatnonzero(stays[:-1] & stays[1:] & (run > k))
        h = _mixed(whole[here] * np.uint64(3) + single[here + k])
        yield here, h


def frequent(docs: DataFrame, least: int):
    """Per level 1 to LONGEST the table of hashes (h) met at least `least` times, and their bitmaps.

    Docs: text, lang. A task sums its hashes whenever it holds HELD of them.
    """
    tables, bitmaps = [], []
    for _ in range(LONGEST):
        def run(batches, bitmaps=tuple(bitmaps)):
            keys, held = [], 0
            for batch in batches:
                for stretch in stretches(batch):
                    *_, (_, h) = _levels(stretch, bitmaps)
                    keys.append(h)
                    held += len(h)
                    if held >= HELD:
                        yield _hash_rows(keys)
                        keys, held = [], 0
            if held:
                yield _hash_rows(keys)

        counts = docs.mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))
        tables.append(written(counts.where(F.col("n") >= least).select("h")))
        bitmaps.append(_bitmap(tables[-1]))
    return tables, bitmaps


def _hash_rows(keys: list) -> pa.RecordBatch:
    both, counts = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_pydict({"h": pa.array(both.view(np.int64)), "n": pa.array(counts.astype(np.int32))})


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The hashes' upper bits as a bitmap of a fixed size; Spark joins the bits of each 64."""
    slot = F.shiftrightunsigned("h", 64 - BITMAP)
    words = hashes.groupBy(F.shiftright(slot, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - BITMAP}) & 63 AS INT))")).alias("bits"))
    found = words.toArrow()
    bitmap = np.zeros(1 << (BITMAP - 6), np.int64)
    bitmap[found["w"].to_numpy()] = found["bits"].to_numpy()
    return bitmap.view(np.uint8)


def windows(docs: DataFrame, bitmaps: list) -> DataFrame:
    """(lang, phrase, n): the longest phrase at each position that may be frequent, and at how many it stands."""

    def run(batches):
        for batch in batches:
            for stretch in stretches(batch):
                words, langs, lang_at, _ = stretch
                longest = np.zeros(len(words), np.int8)
                for k, (here, h) in enumerate(_levels(stretch, bitmaps[:-1]), 1):
                    longest[here[_may_be(bitmaps[k - 1], h)]] = k
                for k in range(1, LONGEST + 1):
                    here = np.flatnonzero(longest == k)
                    found = pa.table({"lang": lang_at[here], "phrase": _phrases(words, here, k)})
                    found = found.group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                    if len(found):
                        lang, phrase, n = (found[c].chunk(0) for c in ("lang", "phrase", "count_all"))
                        yield pa.RecordBatch.from_pydict({"lang": langs.take(lang), "phrase": phrase.cast(pa.binary()), "n": n})

    found = docs.mapInArrow(run, "lang string, phrase binary, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _phrases(words, here: np.ndarray, k: int) -> pa.Array:
    """The k words from each of these positions on."""
    parts = [words.take(pa.array(here + j)) for j in range(k)]
    return parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))


def _split(phrases: pa.Array):
    """The words of phrases as one array, where each phrase begins there, and how many words it has."""
    split = pc.split_pattern(phrases.cast(pa.large_binary()), b" ")
    offsets, words = split.offsets.to_numpy(), split.flatten()
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    words = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at - at[0]), pa.py_buffer(letters)])
    return words, offsets[:-1] - offsets[0], np.diff(offsets)


def candidates(held: DataFrame, tables: list) -> DataFrame:
    """(lang, phrase, size): the distinct phrases behind the frequent hashes, which the windows begin with."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, here, sizes = _split(batch["phrase"])
            langs = batch["lang"].dictionary_encode()
            lang_of = langs.indices.to_numpy()
            single = _hashes(words, langs.dictionary, np.repeat(lang_of, sizes))
            h = single[here]
            for k in range(1, LONGEST + 1):
                if k > 1:
                    more = sizes >= k
                    here, sizes, lang_of, h = here[more], sizes[more], lang_of[more], h[more]
                    h = _mixed(h * np.uint64(3) + single[here + k - 1])
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(h.view(np.int64)), "size": pa.array(np.full(len(h), k, np.int32)),
                    "lang": langs.dictionary.take(pa.array(lang_of)), "phrase": _phrases(words, here, k).cast(pa.binary())})

    found = held.select("lang", "phrase").mapInArrow(run, "h long, size int, lang string, phrase binary").distinct()
    safe = tables[0].withColumn("size", F.lit(1))
    for k, table in enumerate(tables[1:], 2):
        safe = safe.union(table.withColumn("size", F.lit(k)))
    return found.join(safe, ["h", "size"], "left_semi").select("lang", "phrase", "size")


class Trie:
    """A double-array trie: from state s by word c to base[s] + c, if check there names s.

    Places 0 to len(langs) - 1 are the languages' roots, the last place is one that no state leads to.
    number[t] is the phrase that ends in t, else -1.
    """

    def __init__(self, langs: pa.Array, phrases: pa.Array):
        coded = langs.dictionary_encode()
        self.langs, state = coded.dictionary, coded.indices.to_numpy()
        split = pc.split_pattern(phrases.cast(pa.large_binary()), b" ")
        sizes = np.diff(split.offsets.to_numpy())
        words = split.flatten().dictionary_encode()
        self.words = words.dictionary
        codes = np.full((len(sizes), LONGEST), -1, np.int64)
        codes[np.arange(LONGEST) < sizes[:, None]] = words.indices.to_numpy()
        room = len(self.langs) + 2 * int(sizes.sum()) + 2 * len(self.words) + 1
        self.base, self.check, self.number = (np.full(room, x, np.int32) for x in (0, -1, -1))
        self.check[:len(self.langs)] = np.iinfo(np.int32).max
        state = state.astype(np.int64)
        rng = np.random.default_rng(11)
        for level in range(LONGEST):
            live = np.flatnonzero(sizes > level)
            if not len(live):
                break
            pairs, inverse = np.unique(state[live] << 32 | codes[live, level], return_inverse=True)
            parents, own = pairs >> 32, pairs & 0xFFFFFFFF
            self._place(parents, own, rng)
            state[live] = (self.base[parents] + own)[inverse]
            ends = live[sizes[live] == level + 1]
            self.number[state[ends]] = ends

    def _place(self, parents, codes, rng):
        """Gives every parent a base at which all its children's places are free: the largest families first."""
        starts = np.flatnonzero(np.append(True, np.diff(parents) != 0))
        sizes = np.diff(np.append(starts, len(parents)))
        for f in starts.size and np.argsort(-sizes, kind="stable")[:np.count_nonzero(sizes > 1)]:
            own = codes[starts[f]:starts[f] + sizes[f]]
            tries = 64
            while True:
                room = len(self.check) - 1 - int(own[-1])
                at = rng.integers(-int(own[0]), max(room, 1 - int(own[0])), tries)
                fits = (self.check[np.minimum(at[:, None] + own, len(self.check) - 1)] < 0).all(1) & (at < room)
                if fits.any():
                    break
                tries = min(2 * tries, 4096)
                if tries == 4096:
                    self._grow(int(own[-1]) + 1)
            base = at[np.argmax(fits)]
            self.base[parents[starts[f]]] = base
            self.check[base + own] = parents[starts[f]]
        alone = starts[sizes == 1]
        free = np.flatnonzero(self.check[:-1] < 0)
        if len(free) < len(alone):
            self._grow(len(alone))
            free = np.flatnonzero(self.check[:-1] < 0)
        free = free[:len(alone)]
        self.base[parents[alone]] = free - codes[alone]
        self.check[free] = parents[alone]

    def _grow(self, more: int):
        for name, x in (("base", 0), ("check", -1), ("number", -1)):
            setattr(self, name, np.append(getattr(self, name), np.full(more, x, np.int32)))

    def _step(self, state, code):
        last = len(self.check) - 1
        to = self.base[state] + code
        to = np.where((to >= 0) & (to < last) & (code >= 0), to, last)
        return to, self.check[to] == state

    def bins(self, stretch, weight=None) -> np.ndarray:
        """How many positions of a stretch accept in each state; weight: how often each position counts, if not once."""
        words, langs, lang_at, run = stretch
        code = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy()
        root = pc.fill_null(pc.index_in(langs, self.langs), -1).to_numpy()[lang_at]
        here = np.flatnonzero((code >= 0) & (root >= 0) & (True if weight is None else weight > 0))
        state, total = root[here], np.zeros(len(self.check), np.int64)
        for level in range(LONGEST):
            state, known = self._step(state, code[here + level])
            here, state = here[known], state[known]
            if weight is None:
                total += np.bincount(state, minlength=len(total))
            else:
                np.add.at(total, state, weight[here])
            goes_on = run[here] > level + 1
            here, state = here[goes_on], state[goes_on]
        return total


def _counted_in_shard(found: pa.Table, held: pa.Table) -> pa.Table:
    """(id, f) of a shard's candidates, counted in the shard's windows."""
    none = pa.table({"id": pa.array([], pa.int64()), "f": pa.array([], pa.int64())})
    if not len(found) or not len(held):
        return none
    found, held = found.combine_chunks(), held.combine_chunks()
    trie = Trie(*(found[c].chunk(0) for c in ("lang", "phrase")))
    words, first, sizes = _split(held["phrase"].chunk(0))
    langs = held["lang"].chunk(0).dictionary_encode()
    weight = np.zeros(len(words), np.int64)
    weight[first] = held["n"].to_numpy()
    bins = trie.bins((words, langs.dictionary, np.repeat(langs.indices.to_numpy(), sizes), np.repeat(sizes, sizes)), weight)
    at = np.flatnonzero((trie.number >= 0) & (bins > 0))
    return pa.table({"id": found["id"].to_numpy()[trie.number[at]], "f": bins[at]}) if len(at) else none


def counted(held: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, phrase, size, f): how often each candidate begins a window."""
    shards = max(1, -(-found.count() // SHARD))
    # Byte by byte, also where a text is no UTF-8.
    shard = F.pmod(F.xxhash64("lang", F.substring_index(F.decode("phrase", "ISO-8859-1"), " ", 1)), F.lit(shards))
    # Written, the numbers stand; the tasks count by them.
    found = written(found.select("lang", "phrase", "size", F.monotonically_increasing_id().alias("id")))
    own = found.select(shard.alias("shard"), "lang", "phrase", "id").repartition(shards, "shard")
    held = held.select(shard.alias("shard"), "lang", "phrase", "n").repartition(shards, "shard")

    def run(own, held):
        return tidied(_counted_in_shard, own, held)

    sums = own.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(run, "id long, f long")
    return found.join(sums, "id").select("lang", F.col("phrase").cast("string").alias("phrase"), "size", "f")


def mine(docs: DataFrame, least: int = 30, best: int = 2000, share: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best collocations.

    A candidate goes if a longer one that contains it has at least `share` percent of its occurrences.
    """
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    tables, bitmaps = frequent(docs, least)
    held = written(windows(docs, bitmaps))
    found = written(candidates(held, tables))
    counts = written(counted(held, found).where(F.col("f") >= least))
    totals = _word_totals(docs)
    phrases = counts.where("size > 1").withColumn("words", F.split("phrase", " "))

    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ') AS head"),
                       F.expr("array_join(slice(words, k + 1, size(words) - k), ' ') AS rest"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn(
        "score", F.expr("(2000000BD * a) div (CAST(l AS DECIMAL(20,0)) + r)"))
    least_cut = F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k"))
    scored = scored.groupBy("lang", "phrase").agg(least_cut.alias("x")).select("lang", "phrase", "x.*")

    places = F.expr("explode(flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), "
                    "i -> array_join(slice(words, i, m), ' ')))))")
    inner = phrases.where("size > 2").select("lang", F.col("f").alias("longer"), places.alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.expr(f"longer IS NULL OR 100BD * longer < {share}BD * a"))

    # The best of each piece of a language first, so that the last ranking has a bounded number of rows a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(PIECES)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))).where(F.col("rank") <= best)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _word_totals(docs: DataFrame) -> DataFrame:
    """(lang, n): all words of a language."""

    def run(batches):
        for batch in batches:
            for _, langs, lang_at, _ in stretches(batch):
                n = np.bincount(lang_at, minlength=len(langs))
                yield pa.RecordBatch.from_pydict({"lang": langs, "n": pa.array(n.astype(np.int64))})

    return docs.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
