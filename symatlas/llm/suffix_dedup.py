"""Removal of long repeated strings by prefix-free parsing (operator 1).

A text is read as a string over one or both of two alphabets: its bytes, and its words (runs of bytes other than
white space). `lengths` says how long a repeated string is in either, LENGTH bytes and PASSAGE words where the
caller gives no others; 0 leaves an alphabet out.

Rolling-hash triggers (the least hash of window_of(length) successive places) parse every text into phrases that
depend on content alone, so equal strings are parsed alike wherever they stand. A phrase here is a run
of strings of that length with the same first trigger. Of each run the parse keeps two names: that of its
core, which lies in all its strings, and that of its whole extent.

The dictionary is the set of distinct extents, with counts. Cores that occur once end the matter for
their runs; extents that occur again are removed whole; the rest, extents that occur once among others
with the same core, are where repeats begin and end. For those, and for one copy of each other extent
with that core, the prefixes of that length of their suffixes are put in order, each with its neighbours:
equal prefixes of different places are repeats. Only dictionary entries are ordered, never the corpus,
so the work follows the differing text and not the number of copies.

Core and extent names together have 128 bits. Groups are counted by partial aggregation and joined by
sort-merge with skew handling. Entries of one core are ordered in one task only up to GROUP of them;
the strings of a core with more entries are named by 128-bit hashes and counted one by one instead.

Defined results: null and empty texts have 0 bytes and keep the hash of nothing; repeated rows are
occurrences of each other's strings; an empty table gives an empty result; a null doc_id is kept;
further columns, whatever their names, are ignored by removed() and returned unchanged by strip(), which drops the
halves of characters that a cut left and updates n_chars where that column exists.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import common

#: Bytes, and words, of the strings that are looked for.
LENGTH, PASSAGE = 400, 51
SEGMENT = 1 << 20
#: Symbols of several texts that are parsed together, where one text has fewer: the arrays stay in the cache.
BLOCK = 1 << 15
TAG_BITS = 23
#: Most entries of one core that are ordered in one task, and entries ordered at a time: small sorts stay in the cache.
GROUP, CHUNK = 2048, 96

_U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Bytes:
    """A text as a string of bytes; triggers are chosen by hashes of GRAM of them."""

    GRAM, KIND = 16, np.uint8

    @staticmethod
    def symbols(text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8)

    @classmethod
    def several(cls, texts: list[bytes]) -> list[np.ndarray]:
        return [cls.symbols(t) for t in texts]

    @staticmethod
    def grams(raw: np.ndarray) -> np.ndarray:
        h = raw.astype(_U64) + _U64(1)
        for step, factor in ((1, 0x100000001B3), (2, 0x9E3779B1), (4, 0x85EBCA77C2B2AE63), (8, 0x27D4EB2F165667C5)):
            h = common.mix64(h[:-step] * _U64(factor) + h[step:]) if step == 8 else h[:-step] * _U64(factor) + h[step:]
        return h

    @staticmethod
    def marks(raw: np.ndarray) -> np.ndarray:
        """A 32-bit hash of every GRAM bytes: it chooses triggers and names nothing."""
        h = raw.astype(np.uint32) + np.uint32(1)
        for step, factor in ((1, 0x01000193), (2, 0x9E3779B1), (4, 0x85EBCA77), (8, 0xC2B2AE3D)):
            h = h[:-step] * np.uint32(factor) + h[step:]
        for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(factor)
        return h ^ h >> np.uint32(15)

    @staticmethod
    def keys(raw: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
        """A number of at most `bits` bits for every few bytes that orders like them, and how many bytes."""
        size = bits // 8
        key = np.zeros(len(raw) - size + 1, _U64)
        for i in range(size):
            key = key << _U64(8) | raw[i : len(key) + i]
        return key, size


class Words:
    """A text as a string of 64-bit word hashes."""

    GRAM, KIND = 1, _U64
    #: Eights of bytes of a word that are hashed by columns; longer words are hashed one by one.
    LANES = 4

    @classmethod
    def symbols(cls, text: bytes) -> np.ndarray:
        return cls.hashed(text, *cls.places(text))

    @classmethod
    def hashed(cls, text: bytes, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word: of its length and of its bytes, eight at a time."""
        eights = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
        sizes = after - first
        out = sizes.astype(_U64) * _U64(_BASES[0])
        at, left = np.arange(len(first)), sizes
        for lane in range(cls.LANES):
            out[at] = common.mix64(out[at] * _U64(_BASES[1]) ^ eights[first[at] + 8 * lane] & _MASKS[np.minimum(left, 8)])
            at = at[left > 8]
            left = sizes[at] - 8 * (lane + 1)
        for k in at.tolist():
            out[k] = xxhash.xxh3_64_intdigest(text[first[k] : after[k]])
        return out

    @staticmethod
    def grams(raw: np.ndarray) -> np.ndarray:
        return raw

    @staticmethod
    def marks(raw: np.ndarray) -> np.ndarray:
        """A 32-bit hash of every two words: a frequent word by itself would begin more runs."""
        return (common.mix64(raw[:-1] * _U64(_BASES[0]) + raw[1:]) >> _U64(32)).astype(np.uint32)

    @staticmethod
    def keys(raw: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
        return raw, 1

    @staticmethod
    def places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each word, and the byte after it."""
        space = np.ones(len(text) + 2, bool)
        space[1:-1] = _SPACE[np.frombuffer(text, np.uint8)]
        edges = np.flatnonzero(space[1:] != space[:-1])
        return edges[::2], edges[1::2]

    @classmethod
    def several(cls, texts: list[bytes]) -> list[np.ndarray]:
        """The symbols of each text, computed together."""
        text = b" ".join(texts)
        first, after = cls.places(text)
        ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64))
        return np.split(cls.hashed(text, first, after), ends)


ALPHABETS = (Bytes, Words)
#: The lowest bytes of eight, by their number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Cores of different alphabets have different names.
_SALTS = (_U64(0), _U64(0x5851F42D4C957F2D))


def window_of(length: int, alphabet=Bytes) -> int:
    """Places among which the least hash is the trigger of a string; the core is the length - window + 1 symbols from there."""
    window = min(256, length * 16 // 25)
    if length - window + 1 < alphabet.GRAM:
        raise ValueError(f"strings of {length} have cores under {alphabet.GRAM}")
    return window


class Powers:
    """Powers of two odd bases and of their inverses modulo 2**64."""

    def __init__(self):
        self.size = 0

    def upto(self, n: int):
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            self.tables = []
            for base in _BASES:
                both = []
                for b in (base, pow(base, -1, 1 << 64)):
                    p = np.full(self.size, b, _U64)
                    p[0] = 1
                    both.append(np.cumprod(p, dtype=_U64))
                self.tables.append(both)
        return self.tables


class Text:
    """Hashes of all substrings of at least GRAM symbols of a piece of text."""

    def __init__(self, raw: np.ndarray, powers: Powers, alphabet=Bytes):
        self.gram, h = alphabet.GRAM, alphabet.grams(raw)
        tables = powers.upto(len(h) + 1)
        self.sums = []
        self.inverse = []
        for power, inverse in tables:
            s = np.empty(len(h) + 1, _U64)
            s[0] = 0
            np.cumsum(h * power[: len(h)], out=s[1:])
            self.sums.append(s)
            self.inverse.append(inverse)

    def name(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """A 64-bit hash of the symbols from each start to before each end."""
        s = self.sums[which]
        return common.mix64((s[end - self.gram + 1] - s[start]) * self.inverse[which][start])


def triggers(marks: np.ndarray, window: int) -> np.ndarray:
    """For each place with `window` places from there, the place of the least hash among them, the first of equal ones."""
    m = len(marks)
    padded = np.full(-(-m // window) * window, 0xFFFFFFFFFFFFFFFF, _U64)
    padded[:m] = marks.astype(_U64) << _U64(32) | np.arange(m, dtype=_U64)
    grid = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: m - window + 1], ahead[window - 1 : m]) & _U64(0xFFFFFFFF)).astype(np.int64)


def tag_of(text: bytes) -> int:
    """TAG_BITS of hash that tell apart the texts of rows with one doc_id."""
    return xxhash.xxh3_64_intdigest(text) >> (64 - TAG_BITS)


def key_of(doc_id: int | None, text: bytes) -> int:
    """The doc_id; a row without one goes by the hash of its text."""
    return doc_id if doc_id is not None else xxhash.xxh3_64_intdigest(text) - (1 << 63)


def runs(texts: list[bytes], length: int = LENGTH, which: int = 0) -> tuple[np.ndarray, ...]:
    """Number of the text, core name, extent name, and place (tag, alphabet, first string's start, strings less one) of every run.

    Short texts are parsed several at a time, long ones in segments.
    """
    found, pieces, size = [], [], 0
    for few in blocks([i for i, text in enumerate(texts) if len(text) >= length], texts):
        for i, raw in zip(few, ALPHABETS[which].several([texts[i] for i in few])):
            tag = tag_of(texts[i])
            for at in range(0, len(raw) - length + 1, SEGMENT):
                piece = raw[at : at + SEGMENT + length - 1]
                pieces.append((i, at << 8 | which << 40 | tag << 41, piece))
                size += len(piece)
                if size >= BLOCK:
                    found.append(runs_of(pieces, length, which))
                    pieces, size = [], 0
    if pieces:
        found.append(runs_of(pieces, length, which))
    return tuple(np.concatenate(x) for x in zip(*found)) or tuple(np.empty(0, np.int64) for _ in range(4))


def blocks(which: list[int], texts: list[bytes]):
    """The numbers of the texts, in lists that end where their bytes pass 2 * BLOCK."""
    few, size = [], 0
    for i in which:
        few.append(i)
        size += len(texts[i])
        if size >= 2 * BLOCK:
            yield few
            few, size = [], 0
    if few:
        yield few


def runs_of(pieces: list[tuple[int, int, np.ndarray]], length: int, which: int) -> tuple[np.ndarray, ...]:
    """The runs of pieces (number of the text, place of the piece's start, symbols) of at least `length` symbols, laid end to end."""
    alphabet, window = ALPHABETS[which], window_of(length, ALPHABETS[which])
    text, place, parts = zip(*pieces)
    raw, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
    base = np.cumsum(sizes) - sizes
    past = base + sizes - length + 1  # a string that starts from here on leaves its piece
    trigger = triggers(alphabet.marks(raw), window)
    opens = np.zeros(len(trigger) + 1, bool)
    opens[1:-1] = trigger[1:] != trigger[:-1]
    opens[base] = opens[past] = True
    first = np.flatnonzero(opens)
    count = np.diff(first, append=len(trigger))
    piece = np.searchsorted(base, first, "right") - 1
    inside = first < past[piece]
    first, count, piece = first[inside], count[inside], piece[inside]
    t = trigger[first]
    data, unit = raw.tobytes(), raw.itemsize

    def names(hashed, start, end):
        return np.array([hashed(data[a:b]) for a, b in zip((start * unit).tolist(), (end * unit).tolist())], _U64)

    core = names(xxhash.xxh3_64_intdigest, t, t + length - window + 1) ^ _SALTS[which]
    extent = common.mix64(names(xxhash.xxh64_intdigest, first, first + count - 1 + length) ^ common.mix64(((t - first) << 8 | (count - 1)).astype(_U64)))
    place = np.array(place, _U64).view(np.int64)[piece] + ((first - base[piece]) << 8 | (count - 1))
    return np.array(text, np.int64)[piece], core.view(np.int64), extent.view(np.int64), place


def parsed(docs: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """(core, extent, doc, place) of every run of every document."""

    def make():
        def step(batch):
            texts = common.texts(batch)
            keys = np.array([key_of(doc, text) for doc, text in zip(batch.column("doc_id").to_pylist(), texts)], np.int64)
            text, *columns = (np.concatenate(x) for x in zip(*(runs(texts, length, which) for which, length in enumerate(lengths) if length)))
            return dict(zip(("core", "extent", "place"), columns)) | {"doc": keys[text]}

        return step

    names = ("core", "extent", "doc", "place")
    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, ", ".join(f"{n} long" for n in names), [(n, pa.int64()) for n in names])


def packed(docs: DataFrame) -> DataFrame:
    """(doc, tag, doc_id, z): the texts under their join keys, compressed for the shuffle."""

    def make():
        press = zstandard.ZstdCompressor(level=3)

        def step(batch):
            found, ids = common.texts(batch), batch.column("doc_id")
            return {"doc": [key_of(d, t) for d, t in zip(ids.to_pylist(), found)], "tag": [tag_of(t) for t in found], "doc_id": ids, "z": [press.compress(t) for t in found]}

        return step

    kinds = [("doc", pa.int64()), ("tag", pa.int64()), ("doc_id", pa.int64()), ("z", pa.binary())]
    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc long, tag long, doc_id long, z binary", kinds)


#: SQL for the parts of a place.
_START = "shiftright(place, 8) & 4294967295 AS start"
_COUNT = "(place & 255) + 1 AS count"
_TAG = "shiftrightunsigned(place, 41) AS tag"
_WORDS = "(shiftright(place, 40) & 1) = 1 AS words"


def _which(place: int) -> int:
    return place >> 40 & 1


def looked_up(entries: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """The symbols of dictionary entries: doc, tag, z and entries, an array of (core, place, alone, hot), come in.

    An entry goes out as one row with its symbols as text; a hot one as a row for each of its strings, with their
    128-bit names in core and more, and no text.
    """
    kinds = [("core", pa.int64()), ("more", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("alone", pa.bool_()), ("text", pa.binary())]
    schema = pa.schema(kinds)
    common.tuned(entries.sparkSession)

    def ready(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], schema=schema)

    def run(batches):
        powers, press = Powers(), zstandard.ZstdDecompressor()
        for batch in batches:
            lists = batch.column("entries")
            core, place, alone, hot = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("core", "place", "alone", "hot"))
            ends = np.cumsum(lists.value_lengths().to_numpy())
            docs = np.repeat(batch.column("doc").to_numpy(), np.diff(ends, prepend=0))
            which, start, count = place >> 40 & 1, place >> 8 & 0xFFFFFFFF, (place & 255) + 1
            end = start + count - 1 + np.array(lengths)[which]
            which, start, end, cold, at, owns, size = which.tolist(), start.tolist(), end.tolist(), (~hot).tolist(), [], [], 0
            for z, a, b in zip(batch.column("z"), [0, *ends.tolist()], ends.tolist()):
                text, symbols = press.decompress(z.as_py(), max_output_size=1 << 31), {}
                for k in range(a, b):
                    if (w := which[k]) not in symbols:
                        symbols[w] = ALPHABETS[w].symbols(text)
                    own = symbols[w][start[k] : end[k]]
                    if cold[k]:
                        at.append(k)
                        owns.append(own.tobytes())
                        size += own.nbytes
                        if size > common.BATCH_BYTES // 4:
                            yield ready(core[at], np.zeros(len(at)), docs[at], place[at], alone[at], owns)
                            at, owns, size = [], [], 0
                        continue
                    n, hashed, inner = int(count[k]), Text(own, powers, ALPHABETS[w]), np.arange(count[k])
                    w1, w2 = (hashed.name(inner, inner + lengths[w], i).view(np.int64) for i in (0, 1))
                    yield ready(w1, w2, np.full(n, docs[k]), (place[k] & ~0xFF) + (inner << 8), np.full(n, alone[k]), [None] * n)
            if at:
                yield ready(core[at], np.zeros(len(at)), docs[at], place[at], alone[at], owns)

    return entries.mapInArrow(run, "core long, more long, doc long, place long, alone boolean, text binary")


def ranked(key: np.ndarray, bits: int, packed: bool) -> np.ndarray:
    """Rank of every key, equal keys sharing one; if packed, a key leaves `bits` bits for its place and both are sorted as one number."""
    if packed:
        ordered = key << _U64(bits)
        ordered |= np.arange(len(key), dtype=_U64)
        ordered.sort()
        order = (ordered & _U64((1 << bits) - 1)).view(np.int64)
        ordered >>= _U64(bits)
    else:
        order = np.argsort(key)
        ordered = key[order]
    differs = np.zeros(len(key), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=differs[1:])
    rank = np.empty(len(key), _U64)
    rank[order] = np.cumsum(differs, dtype=_U64)
    return rank


def prefix_ranks(raw: np.ndarray, length: int = LENGTH, alphabet=Bytes, starts: np.ndarray | None = None) -> np.ndarray:
    """Rank of the prefix of `length` symbols of the suffixes from `starts`, or of all that have one; equal prefixes share a rank.

    Prefix doubling, by as many ranks at a time as fit into 64 bits beside a place. In each round only those places
    are ordered whose rank a later round takes.
    """
    bits = len(raw).bit_length()
    ways, packed = max(2, 64 // bits - 1), bits * 3 <= 64
    key, size = alphabet.keys(raw, 64 - bits)
    sizes = [size]
    while sizes[-1] < length:
        sizes.append(min(length, ways * sizes[-1]))
    taken = [sorted({min(i * size, reach - size) for i in range(ways)}) for size, reach in zip(sizes, sizes[1:])]
    starts = np.arange(len(raw) - length + 1) if starts is None else starts
    needed = [np.zeros(len(raw), bool)]
    needed[0][starts] = True
    for steps in reversed(taken):
        before = np.zeros(len(raw), bool)
        for at in steps:
            before[at:] |= needed[-1][: len(raw) - at]
        needed.append(before)
    rank = ranked(key, bits, alphabet is Bytes)
    needed.pop()
    for steps, reach in zip(taken, sizes[1:]):
        wanted, n = needed.pop(), len(raw) - reach + 1
        dense = np.count_nonzero(wanted) * 8 > n * 7
        at = None if dense else np.flatnonzero(wanted)
        key = rank[:n] if dense else rank[at]
        for step in steps[1:]:
            key = key << _U64(bits) | (rank[step : step + n] if dense else rank[at + step])
        if dense:
            rank = ranked(key, bits, packed)
        else:
            rank[at] = ranked(key, bits, packed)
    return rank[starts]
    return rank[starts]


def repeats_in(group: list[tuple[int, int, bool, bytes]], length: int = LENGTH, alphabet=Bytes) -> list[tuple[int, int, int]]:
    """(doc, place of the first, number) of runs of strings that occur twice among the entries (doc, place, alone, text)."""
    raw = np.frombuffer(b"".join(g[3] for g in group), alphabet.KIND)
    sizes = np.array([len(g[3]) // raw.itemsize for g in group])
    first = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(group)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    own = prefix_ranks(raw, length, alphabet, np.repeat(first, count) + inner).astype(np.int64)
    twice = np.bincount(own)[own] > 1  # equal neighbours in the suffix order of the entries' strings
    out = []
    hit = np.flatnonzero(twice & np.array([g[2] for g in group])[owner])
    if len(hit):
        for part in np.split(hit, np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1):
            doc, place = group[owner[part[0]]][:2]
            out.append((doc, (place & ~0xFF) + (int(inner[part[0]]) << 8), len(part)))
    return out


def suffix_sorted(entries: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """(doc, tag, words, start, count) of the repeated strings among entries that share a core.

    Entries are dealt by core, at most GROUP to each; a task orders the suffixes of some cores at a time.
    """
    dealt = entries.select("core", "doc", "place", "alone", "text").repartition("core").sortWithinPartitions("core")
    schema = pa.schema([("doc", pa.int64()), ("place", pa.int64()), ("count", pa.int64())])

    def run(batches):
        held: list = []
        for batch in batches:
            for core, *entry in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= CHUNK and core != held[-1][0]:
                    yield made(held)
                    held = []
                held.append((core, tuple(entry)))
        if held:
            yield made(held)

    def made(held):
        found = []
        for which, alphabet in enumerate(ALPHABETS):
            group = [e for _, e in held if _which(e[1]) == which]
            if group:
                found += repeats_in(group, lengths[which], alphabet)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))], schema=schema)

    return dealt.mapInArrow(run, "doc long, place long, count long").select("doc", F.expr(_TAG), F.expr(_WORDS), F.expr(_START), "count")


def repeated(docs: DataFrame, texts: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """(doc, tag, spans): for each text the half-open spans [start, end) of its repeated strings, in bytes or (words) in words."""
    scratch = common.Scratch()
    hashes = {f"parquet.enable.dictionary#{c}": "false" for c in ("core", "extent", "place")}
    parse = scratch.written(parsed(docs, lengths), "parse", **hashes)
    # tables of counts are written before they are joined: a join above two plain exchanges can split a hot key
    cores = scratch.written(parse.groupBy("core").count().filter("count > 1").select("core"), "cores")
    candidates = scratch.written(parse.join(cores, "core"), "candidates")
    scratch.drop(candidates)
    extents = candidates.groupBy("core", "extent").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("copy"))
    extents = scratch.written(extents.select("core", "extent", "n", "copy.*"), "extents")
    several = scratch.written(extents.groupBy("core").agg(F.count("*").alias("m")).filter("m > 1"), "several")
    entries = extents.join(several, "core").select("doc", F.expr(_TAG), F.struct("core", "place", (F.col("n") == 1).alias("alone"), (F.col("m") > GROUP).alias("hot")).alias("e"))
    entries = entries.groupBy("doc", "tag").agg(F.collect_list("e").alias("entries"))
    dictionary = scratch.written(looked_up(entries.join(texts.drop("doc_id").hint("merge"), ["doc", "tag"]), lengths), "dictionary")
    single = suffix_sorted(dictionary.filter("text is not null"), lengths)
    strings = dictionary.filter("text is null").select(F.col("core").alias("w1"), F.col("more").alias("w2"), "doc", "place", "alone")
    twice = scratch.written(strings.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2"), "twice")
    hot = strings.filter("alone").join(twice, ["w1", "w2"]).select("doc", F.expr(_TAG), F.expr(_WORDS), F.expr(_START), F.lit(1).cast("long").alias("count"))
    whole = candidates.join(extents.filter("n > 1").select("core", "extent"), ["core", "extent"]).select("doc", F.expr(_TAG), F.expr(_WORDS), F.expr(_START), F.expr(_COUNT))
    spans = single.unionByName(hot).unionByName(whole)
    end = F.col("start") + F.col("count") + F.when(F.col("words"), lengths[1] - 1).otherwise(lengths[0] - 1)
    spans = spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("words", "start", end.alias("end"))).alias("spans"))
    spans = scratch.written(spans, "spans")
    scratch.drop(spans)
    return spans


_SPANS = pa.list_(pa.struct([("words", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))


def merged(column: pa.Array) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """For each list of spans those in bytes, and those in words, as maximal runs in order."""
    flat = column.flatten()
    words, start, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("words", "start", "end"))
    own = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) << 1 | words
    out: list = [([], []) for _ in range(len(column))]
    if len(own):
        key = own << 33 | start
        order = np.argsort(key)
        key, reach = key[order], np.maximum.accumulate((own << 33 | end)[order])
        opens = np.flatnonzero(np.concatenate([[True], key[1:] > reach[:-1]]))
        reach = reach[np.append(opens[1:], len(key)) - 1]
        for i, a, b in zip((key[opens] >> 33).tolist(), (key[opens] & (1 << 33) - 1).tolist(), (reach & (1 << 33) - 1).tolist()):
            out[i >> 1][i & 1].append((a, b))
    return out


def joined(spans: list | None, words: bool = False) -> list[tuple[int, int]]:
    """The spans of one alphabet as maximal runs, in order."""
    return merged(pa.array([[{k: s[k] for k in ("words", "start", "end")} for s in spans or ()]], _SPANS))[0][words]


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the runs, which are in order; they may overlap."""
    kept, last = [], 0
    for start, end in runs:
        kept.append(text[last:start])
        last = max(last, end)
    kept.append(text[last:])
    return b"".join(kept)


def in_bytes(text: bytes, out: list[tuple[int, int]], words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of both alphabets as runs of bytes, in order."""
    if words:
        first, after = Words.places(text)
        out = out + [(int(first[a]), int(after[b - 1])) for a, b in words]
    return sorted(out)


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages and has_passage of every document.

    Bytes are removed where LENGTH of them occur again. Passages are the maximal runs of words that lie in
    PASSAGE words which occur again, whatever their bytes and the white space between; nothing is removed for them.
    """
    texts = packed(docs)
    both = texts.join(repeated(docs, texts, (LENGTH, PASSAGE)).hint("merge"), ["doc", "tag"], "left").select("doc_id", "z", "spans")

    def make():
        press = zstandard.ZstdDecompressor()

        def step(batch):
            rows = []
            for z, (found, words) in zip(batch.column("z"), merged(batch.column("spans"))):
                text = press.decompress(z.as_py(), max_output_size=1 << 31)
                kept = cut(text, found)
                rows.append((len(text), len(text) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), len(words), len(words) > 0))
            return {"doc_id": batch.column("doc_id")} | dict(zip((k for k, _ in kinds[1:]), zip(*rows)))

        return step

    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("has_passage", pa.bool_())]
    return common.map_batches(both, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, has_passage boolean", kinds)


def strip(docs: DataFrame, lengths: tuple[int, int] = (LENGTH, PASSAGE)) -> DataFrame:
    """The documents without their repeated strings of either alphabet, with all columns."""
    common.tuned(docs.sparkSession)
    spans = repeated(docs, packed(docs), lengths)
    docs, named = common.numbered(docs, "doc_id", "text", "n_chars")
    order = docs.columns
    rest = [c for c in order if c != "text"]
    fields = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in rest)

    def keyed(batches):
        for batch in batches:
            texts = common.texts(batch)
            keys = [key_of(d, t) for d, t in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), texts)]
            more = [batch.column("text"), pa.array(keys, pa.int64()), pa.array([tag_of(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *more], names=[*rest, "text", "doc", "tag"])

    left = common.pressed(docs.mapInArrow(keyed, f"{fields}text string, doc long, tag long"), [*rest, "doc", "tag"])
    both = left.join(spans.hint("merge"), ["doc", "tag"], "left").select(*rest, "z", "spans")

    def shortened(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in rest}
            z, counts = batch.column("z").to_pylist(), columns["n_chars"].to_pylist() if "n_chars" in columns else None
            texts = [t.decode() if z[i] is not None else None for i, t in enumerate(common.unpressed(z))]
            for i, (own, words) in enumerate(merged(batch.column("spans"))):
                if own or words:
                    raw = texts[i].encode()
                    texts[i] = cut(raw, in_bytes(raw, own, words)).decode("utf-8", "ignore")
                    if counts:
                        counts[i] = len(texts[i])
            columns["text"] = pa.array(texts, pa.string())
            if counts:
                columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in order], names=order)

    return named(both.mapInArrow(shortened, docs.schema))


def op1(spark, sf_dir):
    return removed(common.table(spark, sf_dir, "documents", "doc_id", "text"))
