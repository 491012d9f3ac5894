"""Vector codes of equal parts, searched exactly in the integer Walsh-Hadamard domain.

Components become integers floor(256 x). A part and all entries of its codebook are padded with
zeros to a power of two and transformed by integer butterflies; rows of the transform are taken by
their number of sign changes. The transform multiplies squared distances by its size, so squared
differences of coefficients are summed one by one, and an entry whose sum passes the scaled distance
of an entry already measured in full is out. What is left at the end is exact, and the lower index
wins a tie. Nothing here is a floating-point number once the components are integers.

Spark takes the first entries with an ordered limit, and per round adds up what tasks send: one sum
per part, entry and component, so the driver sees codebooks only. Sums travel as 32-bit limbs, thus
no total overflows.

Defined cases: rows whose vector is null, or holds a null or non-finite component, are left out.
Null vec_ids come last, equal ones by their vectors, among the first entries; each row keeps its own
code. Fewer rows than entries give shorter codebooks. Vectors of unequal length, or of a length that
the parts do not divide, are filled up with zeros to the next length that they divide. Errors beyond
a long are given as the largest long. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrogrid.llm.common import ship, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LONGEST = (1 << 63) - 1
TOGETHER = 4096
LIMB = 32


def kept_vectors(table: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the rows whose vector is whole and finite."""
    ship(table.sparkSession)
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), table["embedding"].cast("array<double>").alias("embedding"),
                        table["label"])
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("embedding").isNotNull() & finite)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of all components, one row per vector, filled up with zeros to width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    sizes = np.asarray(column.value_lengths(), np.int64)
    # beyond 2^62, or once the scale has passed the largest double, only Python's integers are exact
    if len(flat) and not np.abs(flat).max() < 2.0 ** 62:
        flat = np.array([int(x * SCALE // 1) if abs(x) < 2.0 ** 62 else int(x) * SCALE
                         for x in np.asarray(column.flatten(), np.float64).tolist()], object)
    else:
        flat = flat.astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def sequency(size: int) -> np.ndarray:
    """Where the rows of the natural order stand, by their number of sign changes."""
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    bits = size.bit_length() - 1
    place = np.zeros(size, np.int64)
    for b in range(bits):
        place |= ((gray >> b) & 1) << (bits - 1 - b)
    return place


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, padded with zeros, in sequency order."""
    n, length = x.shape
    size = 1 << max(0, length - 1).bit_length()
    out = np.zeros((n, size), x.dtype)
    out[:, :length] = x
    step = 1
    while step < size:
        pairs = out.reshape(n, size // (2 * step), 2, step)
        a, b = pairs[:, :, 0, :].copy(), pairs[:, :, 1, :].copy()
        pairs[:, :, 0, :], pairs[:, :, 1, :] = a + b, a - b
        step *= 2
    return out[:, sequency(size)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest entry (lower index first) and the squared distance."""
    length = x.shape[1]
    size = 1 << max(0, length - 1).bit_length()
    largest = max(int(abs(x).max()) if x.size else 0, int(abs(entries).max()) if entries.size else 0)
    if size * length * (2 * largest) ** 2 > LONGEST:
        x, entries = x.astype(object), entries.astype(object)
    tx, te = transformed(x), transformed(entries)
    # the first coefficient of all entries proposes one; its full sum bounds the others
    part = (tx[:, :1] - te[None, :, 0]) ** 2
    guess = part.argmin(axis=1)
    bound = ((tx - te[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(part <= bound[:, None])
    total = part[row, entry]
    for k in range(1, size):
        total = total + (tx[row, k] - te[entry, k]) ** 2
        on = total <= bound[row]
        if not on.all():
            row, entry, total = row[on], entry[on], total[on]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    least = np.minimum.reduceat(total, first) if len(row) else total
    hit = np.flatnonzero(total == np.repeat(least, np.diff(np.append(first, len(row)))))
    hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])] if len(hit) else hit
    return entry[hit], total[hit] // size


def parts_of(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows by part and component: shape (parts, rows, length of a part)."""
    return x.reshape(len(x), parts, x.shape[1] // parts).transpose(1, 0, 2)


def first_entries(kept: DataFrame, entries: int, parts: int) -> tuple[list[np.ndarray], int]:
    """The codebooks of the first vectors by vec_id, and the length that all vectors are filled up to."""
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).first()["n"]
    width = max(1, -(-(longest or 0) // parts)) * parts
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    x = integers(rows.column("embedding"), width)
    return list(parts_of(x, parts)), width


def limbs(total: int) -> list[int]:
    """A number as signed 32-bit limbs, the lowest first: all but the last lie from 0 to 2^32 - 1."""
    found = []
    while not -(1 << LIMB) <= total < 1 << LIMB:
        found.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*found, total]


def sums(kept: DataFrame, books: list[np.ndarray], width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each part and entry that is some part's nearest: how many parts, and their sums by component."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    parts = len(books)
    length = width // parts

    def partial(batches):
        held: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                x = parts_of(integers(batch.column("embedding").slice(at, TOGETHER), width), parts)
                for p, book in enumerate(shared.value):
                    entry, _ = nearest(x[p], book)
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    rows = x[p][order]
                    if rows.dtype != object and int(abs(rows).max()) * len(rows) > LONGEST:
                        rows = rows.astype(object)
                    added = np.add.reduceat(rows, first, axis=0)
                    counts = np.diff(np.append(first, len(order)))
                    for e, n, line in zip(used.tolist(), counts.tolist(), added.tolist(), strict=True):
                        held[p, e, -1] = held.get((p, e, -1), 0) + n
                        for c, v in enumerate(line):
                            held[p, e, c] = held.get((p, e, c), 0) + v
        out = [(p, e, c, i, v) for (p, e, c), total in held.items() for i, v in enumerate(limbs(total))]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "component", "limb", "v"])

    added = (
        kept.select("embedding").mapInArrow(partial, "part long, entry long, component long, limb long, v long")
        .groupBy("part", "entry", "component", "limb").agg(F.sum("v").alias("v")).collect()  # as many as codebook cells
    )
    shared.unpersist()
    totals: dict[tuple[int, int], list[int]] = {}
    for r in added:
        cells = totals.setdefault((r["part"], r["entry"]), [0] * (length + 1))
        cells[r["component"]] += r["v"] << (LIMB * r["limb"])
    return {at: (cells[-1], cells[:-1]) for at, cells in totals.items()}


def codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """One array of entries per part after the given rounds, and the common length of vectors."""
    books, width = first_entries(kept, entries, parts)
    for _ in range(rounds if len(books[0]) else 0):
        books = [list(map(list, book.tolist())) for book in books]
        arrays = [whole(book) for book in books]
        for (p, e), (n, line) in sums(kept, arrays, width).items():
            books[p][e] = [v // n for v in line]
        books = [whole(book) for book in books]
    return books, width


def whole(lines: list[list[int]]) -> np.ndarray:
    """An integer array, of Python's integers where 64 bits do not hold them."""
    fits = all(abs(v) < 1 << 62 for line in lines for v in line)
    return np.array(lines, np.int64 if fits else object)


def digest(books: list[np.ndarray]) -> str:
    """The SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for book in books for line in book.tolist() for v in line).encode()).hexdigest()


def encoded(kept: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """vec_id, code, error and label of each row."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    parts = len(books)

    def code(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(at, TOGETHER)
                x = parts_of(integers(piece.column("embedding"), width), parts)
                found = [nearest(x[p], book) for p, book in enumerate(shared.value)]
                text = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                error = [min(LONGEST, sum(line)) for line in zip(*(d.tolist() for _, d in found), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("vec_id"), pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()),
                     pa.array(error, pa.int64()), piece.column("label")], names=["vec_id", "code", "error", "label"])

    schema = f"vec_id long, code string, error long, label {kept.schema['label'].dataType.simpleString()}"
    return kept.mapInArrow(code, schema)


def vector_codes(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("two hexadecimal digits number 256 entries at most")
    kept = kept_vectors(table)
    books, width = codebooks(kept, parts, entries, rounds)
    rows = stored(encoded(kept, books, width), "vector-codes")
    # errors are never negative; their sum may pass a long
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    # a written table, so Spark knows its size and broadcasts few labels; many are joined with split hot keys
    labels = stored(rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "vector-label-errors")
    return (
        rows.join(labels, rows["label"].eqNullSafe(labels["of"]), "left")
        .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    )


def oracle_sql() -> str:
    """The same rows in DuckDB, with the rounds written out (vec_id is unique and all lengths are equal there)."""
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(n: int) -> str:
        return f"""
        near{n} AS (
            SELECT vec_id, part, min(d)::BIGINT AS d, min(entry) FILTER (d = least_d) AS entry FROM (
                SELECT *, min(d) OVER (PARTITION BY vec_id, part) AS least_d FROM (
                    SELECT p.vec_id, p.part, c.entry, {distance} AS d FROM parts p JOIN book{n} c USING (part)))
            GROUP BY vec_id, part
        )"""

    def moved(n: int) -> str:
        return f"""
        total{n} AS (
            SELECT n.part, n.entry, u.place, sum(p.v[u.place])::BIGINT AS s, count(*) AS k
            FROM near{n} n JOIN parts p USING (vec_id, part), places u GROUP BY ALL
        ),
        mean{n} AS (
            SELECT part, entry, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY place) AS v FROM total{n} GROUP BY ALL
        ),
        book{n + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN mean{n} m USING (part, entry))"""

    rounds = ",".join(f"{assigned(n)},{moved(n)}" for n in range(ROUNDS))
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        parts AS (
            SELECT vec_id, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v
            FROM kept, (SELECT unnest(range({PARTS})) AS part)
        ),
        places AS (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM parts))) AS place),
        chosen AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}),
        book0 AS (SELECT part, entry, v FROM chosen JOIN parts USING (vec_id)),
        {rounds},{assigned(ROUNDS)},
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
            FROM near{ROUNDS} GROUP BY vec_id
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)
    """
