"""Operator 11: codes of vectors by product quantisation, with partial-distance search for the nearest entries.

A vector of integers is cut into consecutive parts; each part position has a codebook. To find the entry nearest to a
part, the places are taken in the order of falling codebook variance; a mask drops an entry of a row as soon as the sum
of its squared differences so far is strictly larger than the least distance that is known in full for that row. All is done for
an Arrow batch at once. Codebooks are trained by rounds over all rows: a task adds up the parts of each entry and sends
one row an entry; codebooks (parts x entries rows) are all that the driver holds.

Defined edge cases: a row whose vector is null or has an entry that is null, not finite or of 2^40 or more in size is left out, as
are rows of another than the commonest vector length; a length that the number of parts doesn't divide gives its first parts one
place more; fewer rows than entries make shorter codebooks; rows without vec_id come last among those that the codebooks
start from, of equal ids the smaller vector first; equal entries and equal distances give the lower index;
``error`` and ``label_error`` are null where they pass 64 bits; empty tables give no rows, empty vectors code 0; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage, table
from .vectors import matrix, one_width, usable, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, BOUND = 256, 2.0**40


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of and squared distance to the entry of ``book`` nearest to each row of ``x``; how many squared differences that took.

    Both are integers; of equally near entries the first counts.
    """
    n, width = x.shape
    if not width or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    most = float(np.abs(x).max()) + float(max(abs(int(v)) for v in book.ravel()))
    x, book = whole(x, most * most * width), whole(book, most * most * width)
    order = np.argsort(-np.var(book.astype(float), axis=0), kind="stable")
    so_far = (x[:, order[0], None] - book[None, :, order[0]]) ** 2
    done = so_far.size
    rows, places = np.arange(n), so_far.argmin(axis=1)
    best = ((x - book[places]) ** 2).sum(axis=1)
    row, entry = np.nonzero(so_far <= best[:, None])
    so_far = so_far[row, entry]
    for at, d in enumerate(order[1:], 2):
        so_far = so_far + (x[row, d] - book[entry, d]) ** 2
        done += len(row)
        keep = so_far <= best[row]
        row, entry, so_far = row[keep], entry[keep], so_far[keep]
        starts = np.searchsorted(row, rows)  # the entry that gave the best distance is always there
        if at < width:  # complete the entry that leads now, for a tighter bound
            lead = np.minimum.reduceat(so_far, starts)
            first = np.flatnonzero(so_far == lead[row])
            first = first[np.searchsorted(row[first], rows)]
            best = np.minimum(best, ((x - book[entry[first]]) ** 2).sum(axis=1))
            keep = so_far <= best[row]
            row, entry, so_far = row[keep], entry[keep], so_far[keep]
    starts = np.searchsorted(row, rows)
    least = np.minimum.reduceat(so_far, starts)
    first = np.flatnonzero(so_far == least[row])
    first = first[np.searchsorted(row[first], rows)]
    return entry[first], least, done


def cuts(width: int, parts: int) -> list[int]:
    return [i * (width // parts) + min(i, width % parts) for i in range(parts + 1)]


@dataclass
class Codebooks:
    """One integer matrix (entries, places) per part; ``column`` is read from the tables that are encoded."""

    books: list[np.ndarray]

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
        import hashlib

        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel()).encode()).hexdigest()

    def encode(self, rows: DataFrame, keep: list[str], column: str = "embedding") -> DataFrame:
        """``keep, code, error``: two hex digits a part, and the squared distance of the vector to what its code stands for (decimal)."""
        books, width = self.books, self.width
        edges = np.cumsum([0, *(b.shape[1] for b in books)])

        def run(batches):
            from decimal import Decimal

            import pyarrow as pa

            for batch in batches:
                x = quantised(matrix(batch.column(batch.num_columns - 1), width))
                codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), object)
                for p, book in enumerate(books):
                    codes[:, p], far, _ = nearest(x[:, edges[p] : edges[p + 1]], book)
                    error = error + far
                text = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(text, pa.string()), pa.array([Decimal(int(e)) for e in error], pa.decimal128(38, 0))], [*batch.schema.names[:-1], "code", "error"]
                )

        kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
        kept = usable(rows, column, BOUND).where(F.size(column) == width)
        return small_batches(kept).select(*keep, column).mapInArrow(run, f"{kinds}, code string, error decimal(38,0)")

    def decode(self, codes: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
        """``keep, embedding``: the vector that a code stands for, in the units of the table that the codebooks were trained on."""
        books = F.array(*[F.array(*[F.array(*[F.lit(float(v) / SCALE) for v in e]) for e in b]) for b in self.books])
        parts = F.transform(F.sequence(F.lit(0), F.lit(len(self.books) - 1)), lambda p: F.get(F.get(F.col("_books"), p), F.conv(F.substring(F.col(code), p * 2 + 1, F.lit(2)), 16, 10).cast("int")))
        return codes.withColumn("_books", books).select(*keep, F.flatten(parts).alias("embedding"))


def train(rows: DataFrame, row_id: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks that start from the rows of the smallest ids and move to the whole part of the mean of their parts each round; None without a row."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept, width = one_width(usable(rows, column, BOUND), column)
    start = kept.select(row_id, column).orderBy(F.col(row_id).asc_nulls_last(), column).limit(entries).collect()
    if not start:
        return None
    edges = cuts(width, parts)
    x = quantised(np.array([r[1] for r in start], np.float64).reshape(len(start), width))
    books = [x[:, a:b].copy() for a, b in zip(edges, edges[1:])]
    for _ in range(rounds):
        sums = _totals(kept.select(column), books, width)
        for p, book in enumerate(books):
            for e in range(len(book)):
                n, s = sums.get((p, e), (0, ()))
                if n:
                    book[e] = [v // n for v in s]
    return Codebooks(books)


def _totals(rows: DataFrame, books: list[np.ndarray], width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """How many parts each entry is nearest to, and their sums by place; exact."""
    edges = np.cumsum([0, *(b.shape[1] for b in books)])
    most = max(b.shape[1] for b in books)

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            x = quantised(matrix(batch.column(0), width))
            for p, book in enumerate(books):
                part = x[:, edges[p] : edges[p + 1]]
                at, _, _ = nearest(part, book)
                counts[p] += np.bincount(at, minlength=len(book))
                for start in range(0, len(part), 8192):  # 2^13 rows of less than 2^48 in size fit 64 bits
                    own = np.zeros(book.shape, np.int64)
                    np.add.at(own, at[start : start + 8192], part[start : start + 8192])
                    sums[p] = sums[p] + own
        rows = [(p, e, int(counts[p][e]), sums[p][e]) for p in range(len(books)) for e in range(len(books[p])) if counts[p][e]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.int64()),
                *[pa.array([Decimal(int(r[3][d])) if d < len(r[3]) else None for r in rows], pa.decimal128(38, 0)) for d in range(most)],
            ],
            ["part", "entry", "n", *(f"s{d}" for d in range(most))],
        )

    schema = "part int, entry int, n bigint" + "".join(f", s{d} decimal(38,0)" for d in range(most))
    got = small_batches(rows).mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n"), *[F.sum(f"s{d}") for d in range(most)]).collect()
    return {(r[0], r[1]): (r[2], [int(v) for v in r[3:] if v is not None]) for r in got}


def sums_by_key(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over their key, null keys together.

    A key that holds more than its share of the rows (all of them over the shuffle partitions) is joined by broadcast; there are fewer such
    keys than partitions. The others are joined by a shuffle in which no key is large.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = stage(rows.groupBy(key).agg(F.sum(value).alias(name), F.count("*").alias("_n")), "sums")
    all_rows = sums.agg(F.sum("_n")).first()[0] or 0
    mine, theirs = F.struct(F.col(key)), F.col("_key")
    hot = F.broadcast(sums.where(F.col("_n") * parts > all_rows).select(F.struct(key).alias("_key"), name))
    rest = sums.where(F.col("_n") * parts <= all_rows).select(F.struct(key).alias("_key"), name)
    marked = rows.withColumn("_row", mine)
    near = marked.join(hot, marked["_row"] == theirs).drop("_row", "_key")
    far = marked.join(hot, marked["_row"] == theirs, "left_anti")
    return near.unionByName(far.join(rest, far["_row"] == theirs).drop("_row", "_key"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    books = train(rows)
    if books is None:
        kinds = {k: rows.schema[k].dataType.simpleString() for k in ("vec_id", "label")}
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = stage(books.encode(rows, ["vec_id", "label"]), "codes")
    out = sums_by_key(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", F.col("error").try_cast("bigint").alias("error"), F.col("label_error").try_cast("bigint").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


#: Three rounds of all parts against all entries.
def _assign(k: int) -> str:
    return f"""a{k} AS (SELECT vec_id, part, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM (
  SELECT p.vec_id, p.part, c.e, (p.w[1] - c.w[1]) ** 2 + (p.w[2] - c.w[2]) ** 2 + (p.w[3] - c.w[3]) ** 2 + (p.w[4] - c.w[4]) ** 2 AS d0, CAST(d0 AS BIGINT) AS d FROM p JOIN c{k} c USING (part)) GROUP BY 1, 2)"""


def _moved(k: int) -> str:
    mean = ", ".join(f"CAST(floor(sum(p.w[{i}]) / CAST(count(*) AS DOUBLE)) AS BIGINT)" for i in range(1, 5))
    return f"""c{k} AS (SELECT c.part, c.e, coalesce(m.w, c.w) AS w FROM c{k - 1} c LEFT JOIN (
  SELECT p.part, a.e, [{mean}] AS w FROM p JOIN a{k - 1} a USING (vec_id, part) GROUP BY 1, 2) m USING (part, e))"""


OP11_SQL = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, x[4 * part + 1 : 4 * part + 4] AS w FROM v CROSS JOIN (SELECT unnest(range(16)) AS part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < 64),
c0 AS (SELECT part, e, w FROM p JOIN f USING (vec_id)), {_assign(0)}, {_moved(1)}, {_assign(1)}, {_moved(2)}, {_assign(2)},
h AS (SELECT sha256(string_agg(CAST(n AS VARCHAR), ',' ORDER BY part, e, i)) AS h FROM (SELECT part, e, unnest(w) AS n, generate_subscripts(w, 1) AS i FROM c2)),
o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o JOIN v USING (vec_id) CROSS JOIN h"""
