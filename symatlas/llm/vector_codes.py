"""Product-quantisation codes of vectors with exact integer codebooks, assigned by exponion search (operator 12).

Components become integers floor(SCALE * x); a vector is cut into PARTS consecutive parts, and each part
position has a codebook of ENTRIES integer entries that starts as the parts of the smallest vec_ids. A
round assigns every part to its nearest entry and moves every entry to the floored mean of its parts.

Assignment starts at a part's previous entry a, at distance u: by the triangle inequality an entry j can
be as near as the best one so far, at distance b, only if d(a, j) <= u + b. So a's neighbours, sorted by
distance, are scanned until that radius ends, and the radius shrinks as better entries are found. The
radius is compared with a margin for rounding; distances themselves are exact integers, and at equal
distances the lower index wins.

A round reads the table of the one before (id, label, integers, codes) from the shared folder and writes
the next; sums and counts by entry come from a second pass over what was written, partial sums first.
Only the codebooks reach the driver: PARTS * ENTRIES entries, whatever the table. Nothing else is
shuffled but error totals by label.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped. A vector
whose length is not that of the smallest vec_id's (the codebooks' length) has no code: code and error are
null and it adds nothing to label_error. A length that PARTS does not divide gives the first parts one
component more. With fewer than ENTRIES vectors there are as many entries as vectors, with none an empty
result. Repeated rows and ids each count; at equal vec_ids codebooks start in order of the vectors' bytes, null
vec_ids come last. Components beyond 2**25 after scaling take a slower path in unbounded integers, and an
error beyond a long is the greatest long. Further columns are ignored by op12 and coded() takes any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Magnitude up to which sums of squares of a part stay exact in 64 bits for parts of up to 2**10 components.
SMALL = 1 << 25
LONGEST = (1 << 63) - 1
#: Sums travel in limbs of so many bits, so that they are exact whatever the components and their number.
LIMB_BITS = 24


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, or as Python integers if one is beyond SMALL."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() <= SMALL:
        return scaled.astype(np.int64)
    import math
    from fractions import Fraction

    exact = [math.floor(Fraction(float(x)) * SCALE) for x in values.ravel()]
    return np.array(exact, dtype=object).reshape(values.shape)


def packed(vector: np.ndarray) -> bytes:
    """A vector of integers in the fewest bytes of one width; the first byte is the width, 0 for decimal text."""
    if vector.dtype == object:
        return b"\x00" + ",".join(map(str, vector)).encode()
    low, high = (int(vector.min()), int(vector.max())) if vector.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + vector.astype(f"<i{width}").tobytes()


def unpacked(value: bytes) -> np.ndarray:
    if value[0]:
        return np.frombuffer(value, f"<i{value[0]}", offset=1).astype(np.int64)
    return np.array([int(x) for x in value[1:].split(b",")], dtype=object)


def dims_of(value: bytes) -> int:
    return (len(value) - 1) // value[0] if value[0] else value.count(b",") + 1


def matrix(values: list[bytes]) -> np.ndarray:
    """Packed vectors of one length as rows."""
    width = values[0][0]
    if width and all(v[0] == width for v in values):
        return np.frombuffer(b"".join(v[1:] for v in values), f"<i{width}").astype(np.int64).reshape(len(values), -1)
    rows = [unpacked(v) for v in values]
    return np.stack(rows) if all(r.dtype != object for r in rows) else np.array([r.astype(object) for r in rows], dtype=object)


def roots(squares: np.ndarray) -> np.ndarray | None:
    """Square roots as doubles; None if a square is beyond doubles."""
    try:
        return np.sqrt(squares.astype(np.float64))
    except OverflowError:
        return None


class Codebook:
    """One part position's entries, and for each entry the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries if entries.dtype == object or np.abs(entries).max(initial=0) <= SMALL else entries.astype(object)
        apart = roots(((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(2))
        if apart is None:  # beyond doubles no radius is known: all entries are scanned
            apart = np.zeros((len(entries), len(entries)))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)

    def nearest(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part; the search starts at entry `start` of each."""
        entries = self.entries
        if parts.dtype == object or entries.dtype == object:
            parts, entries = parts.astype(object), entries.astype(object)
        best, least = start.copy(), ((parts - entries[start]) ** 2).sum(1)
        begun = roots(least)
        live = np.arange(len(parts))
        for k in range(len(entries)):
            if begun is not None:
                # an entry farther from the start than u + b is farther from the part than b; the margin covers rounding
                radius = (begun[live] + roots(least[live])) * (1 + 1e-9)
                live = live[self.apart[start[live], k] <= radius]
            if not live.size:
                break
            entry = self.order[start[live], k]
            apart = ((parts[live] - entries[entry]) ** 2).sum(1)
            better = ((apart < least[live]) | ((apart == least[live]) & (entry < best[live]))).astype(bool)
            best[live[better]], least[live[better]] = entry[better], apart[better]
        return best, least


def cuts(dims: int) -> list[slice]:
    """The places of the parts."""
    ends = np.cumsum([len(x) for x in np.array_split(np.arange(dims), PARTS)])
    return [slice(int(a), int(b)) for a, b in zip([0, *ends], ends)]


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


_STATE = [("id", pa.int64()), ("label", pa.string()), ("q", pa.binary()), ("codes", pa.binary()), ("error", pa.int64())]
_SCHEMA = "id long, label string, q binary, codes binary, error long"
#: Rows of a batch: searches of a batch run together.
ROWS = 8192


def _quantised(vectors: DataFrame) -> DataFrame:
    """(id, label, q, codes, error) of the rows that are kept, with nothing assigned yet."""

    def step(batch):
        ids, labels, out = batch.column("id").to_pylist(), batch.column("label").to_pylist(), {n: [] for n, _ in _STATE}
        for vec_id, label, vector in zip(ids, labels, batch.column("vector")):
            if not vector.is_valid or vector.values.null_count:
                continue
            values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(values).all():
                for name, x in zip(out, (vec_id, label, packed(integers(values)), None, None)):
                    out[name].append(x)
        return out

    return common.map_batches(vectors, lambda: step, _SCHEMA, _STATE)


def _wide(frame: DataFrame) -> DataFrame:
    """Batches of ROWS vectors for a frame that runs next: the bytes of a batch stay bounded as before."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return frame


def _assigned(state: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The state with every vector's codes and error for the codebooks."""
    dims = sum(b.shape[1] for b in books)
    places = cuts(dims)

    def make():
        tables = [Codebook(b) for b in books]

        def step(batch):
            q, before = batch.column("q").to_pylist(), batch.column("codes").to_pylist()
            fits = [i for i, v in enumerate(q) if dims_of(v) == dims]
            codes: list = [None] * len(q)
            errors: list = [None] * len(q)
            if fits:
                rows = matrix([q[i] for i in fits])
                start = np.array([list(before[i]) if before[i] is not None else [0] * PARTS for i in fits], np.int64)
                found = [t.nearest(rows[:, p], start[:, k]) for k, (t, p) in enumerate(zip(tables, places))]
                code = np.stack([f[0] for f in found], 1).astype(np.uint8)
                total = sum(f[1].astype(object) for f in found)
                for n, i in enumerate(fits):
                    codes[i], errors[i] = code[n].tobytes(), min(int(total[n]), LONGEST)
            return {"id": batch.column("id"), "label": batch.column("label"), "q": batch.column("q"), "codes": codes, "error": errors}

        return step

    return _wide(common.map_batches(state, make, _SCHEMA, _STATE))


def _moved(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The entries as floored means of their parts; entries without parts stay.

    Sums and counts are partial sums of each task by (part, entry, component, limb), then of all tasks.
    """
    widths = [b.shape[1] for b in books]
    places, wide = cuts(sum(widths)), max(widths) + 1

    def make():
        def step(batch):
            coded = [i for i, c in enumerate(batch.column("codes").to_pylist()) if c is not None]
            if not coded:
                return {"slot": [], "limb": [], "total": []}
            taken = batch.take(pa.array(coded, pa.int64()))
            rows = matrix(taken.column("q").to_pylist())
            codes = np.array([list(c) for c in taken.column("codes").to_pylist()], np.int64)
            slots, limbs, totals = [], [], []

            def put(slot, limb, total):
                slots.append(slot), limbs.append(np.full(len(slot), limb)), totals.append(total)

            for k, place in enumerate(places):
                entries, inverse = np.unique(codes[:, k], return_inverse=True)
                base = (k * ENTRIES + entries) * wide
                put(base + wide - 1, 0, np.bincount(inverse, minlength=len(entries)))
                rest, limb = rows[:, place], 0
                slot = (base[:, None] + np.arange(place.stop - place.start)).ravel()
                while True:
                    high = rest >> LIMB_BITS
                    last = bool((high == (high >> 1)).all())  # only the sign is left: the top limb keeps it
                    low = (rest if last else rest - (high << LIMB_BITS)).astype(np.int64)
                    sums = np.zeros((len(entries), low.shape[1]), np.int64)
                    np.add.at(sums, inverse, low)
                    put(slot, limb, sums.ravel())
                    if last:
                        break
                    rest, limb = high, limb + 1
            return {"slot": np.concatenate(slots), "limb": np.concatenate(limbs), "total": np.concatenate(totals)}

        return step

    partial = _wide(common.map_batches(state.select("q", "codes"), make, "slot long, limb int, total long", [("slot", pa.int64()), ("limb", pa.int32()), ("total", pa.int64())]))
    sums = [[[0] * wide for _ in range(len(b))] for b in books]
    for slot, limb, total in partial.groupBy("slot", "limb").agg(F.sum("total")).collect():  # a row for each component of the codebooks and limb
        part, entry = divmod(slot // wide, ENTRIES)
        sums[part][entry][slot % wide] += total << (LIMB_BITS * limb)
    out = []
    for book, rows in zip(books, sums):
        moved = [[x // row[-1] for x in row[: book.shape[1]]] if row[-1] else [int(x) for x in entry] for entry, row in zip(book, rows)]
        big = any(abs(x) > SMALL for row in moved for x in row)
        out.append(np.array(moved, dtype=object if big else np.int64).reshape(book.shape))
    return out


def first_codebooks(state: DataFrame) -> list[np.ndarray]:
    """Codebooks from the vectors of the ENTRIES smallest ids; empty if there are no vectors."""
    first = [r["q"] for r in state.select("id", "q").orderBy(F.col("id").asc_nulls_last(), "q").limit(ENTRIES).collect()]  # at most ENTRIES vectors
    rows = [unpacked(v) for v in first]
    rows = [r for r in rows if len(r) == len(rows[0])]
    if not rows:
        return []
    table = matrix([packed(r) for r in rows])
    return [table[:, p] for p in cuts(table.shape[1])]


def coded(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, q, codes, error) of every kept vector, the final codebooks); label as text.

    The codes are PARTS bytes, q the vector's integers as packed() writes them.
    """
    common.tuned(vectors.sparkSession)
    scratch = common.Scratch()
    ends = [vectors[f"`{c}`"] for c in (vec_id, label, vector)]
    own = vectors.select(ends[0].cast("long").alias("id"), ends[1].cast("string").alias("label"), ends[2].cast("array<double>").alias("vector"))
    state = scratch.written(_quantised(own), "vectors")
    books = first_codebooks(state)
    for _ in range(ROUNDS if books else 0):
        state = scratch.written(_assigned(state, books), "vectors")
        books = _moved(state, books)
        scratch.drop(state)
    if books:
        state = scratch.written(_assigned(state, books), "vectors")
        scratch.drop(state)
    return state, books


def op12(spark, sf_dir):
    vectors = common.table(spark, sf_dir, "embeddings")
    state, books = coded(vectors)
    totals = common.written(state.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "label-errors")
    both = state.join(totals, state["label"].eqNullSafe(totals["label"]), "left").select(state["id"], state["codes"], state["error"], "total")
    return both.select(
        F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error",
        F.least(F.coalesce("total", F.lit(0)), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"),
    )
