"""Hard negatives by vantage-point trees over norm-augmented vectors.

A window of scores around an anchor is an annulus of distances (see vptree). A coarse tree, fitted on
a bounded sample, sends every row to a cell; an anchor visits the cells that its annulus meets, and in
each block of a cell a tree of its own is searched nearest first until k rows are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import cluster, grid, vptree

#: Rows and bytes of the sample that the coarse tree is fitted on, and sampled rows behind a cell at least.
SAMPLE, SAMPLE_BYTES, CELL_SAMPLE = 20_000, 16 << 20, 32
#: Rows of a block (those of an eighth of a hundredth of the table, within these bounds and the bytes), rows of a leaf, anchors that meet a block in one task, windows searched at a time.
BLOCK_ROWS, BLOCK_BYTES, LEAF, ANCHORS, WINDOWS = (512, 32_768), 16 << 20, 128, 16_384, 1024
WIDEST = 1 << 62


class Mine:
    """The rows that take part, dealt to cells and blocks, and the sample with its tree."""

    def __init__(self, rows: DataFrame, width: int, keep: int):
        """rows: vec_id, label, x. keep: rows with the smallest vec_id that equal vectors of a label keep; more can be among no first keep - 1."""
        self.spark, self.width = rows.sparkSession, width

        def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = grid.unpack(batch.column("x"), width)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x * x).sum(1))], names=["vec_id", "label", "x", "norm"])

        w = Window.partitionBy("x", "label").orderBy("vec_id")
        few = rows.distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).drop("r")
        self.points = cluster.written(few.mapInArrow(norms, "vec_id long, label long, x binary, norm long"), "points")
        total = self.points.agg(F.max("norm").alias("most"), F.count("*").alias("n")).first()
        self.most, self.n = total.most or 0, total.n
        size = min(SAMPLE, SAMPLE_BYTES // (8 * (width + 1)))
        share = min(1.0, size / max(1, self.n))
        picked = self.points.filter(F.pmod(F.xxhash64("x", "label", "vec_id"), F.lit(1_000_003)) < F.lit(math.ceil(share * 1_000_003))).limit(2 * size).collect()
        self.sample = (grid.unpack(pa.array([p.x for p in picked], pa.binary()), width), np.array([p.vec_id for p in picked], np.int64), np.array([p.label for p in picked], np.int64))
        floats = vptree.augmented(self.sample[0], self.most)
        self.block_rows = max(1, min(max(BLOCK_ROWS[0], self.n // 64), BLOCK_ROWS[1], BLOCK_BYTES // (8 * width)))
        cells = min(math.ceil(self.n / self.block_rows), len(picked) // CELL_SAMPLE)
        self.tree = vptree.Tree(floats, max(0, cells - 1).bit_length(), open_ends=True)
        self.tree.leaf = None  # of the sample's rows: not needed
        tree, most = self.tree, self.most

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = tree.route(vptree.augmented(grid.unpack(batch.column("x"), width), most))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "label", "x", "cell"])

        self.placed = cluster.written(self.points.select("vec_id", "label", "x").mapInArrow(place, "vec_id long, label long, x binary, cell long"), "placed")
        counts = self.placed.groupBy("cell").count().collect()  # a row a cell
        self.blocks = {r.cell: math.ceil(r["count"] / self.block_rows) for r in counts}

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor, label, vec_id of the anchor, tag, top (of a window), id, score: the k best rows of each window and block, or more of equal score.

        anchors: anchor (a key), vec_id, label, x, windows (array of tag, low, high). Rows have the anchor's label if same, else another;
        a row with the anchor's vec_id is none of its own. Rounds: the sample narrows each window to what can be among its first k,
        then anchors go to the blocks of the cells that their windows meet.
        """
        width, most, tree, blocks, sample = self.width, self.most, self.tree, self.blocks, self.sample
        whole = vptree.Tree(vptree.augmented(sample[0], most), max(0, len(sample[0]) // LEAF).bit_length())
        parts = max(1, math.ceil(anchors.count() / ANCHORS))

        def windows(column: pa.Array) -> tuple[np.ndarray, ...]:
            flat = column.flatten()
            at = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            return at, *(flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))

        def found(tree, x, ids, labels, batch, at, low, high):
            """Searches WINDOWS at a time."""
            own, lab, q = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), grid.unpack(batch.column("x"), width)
            for start in range(0, len(at), WINDOWS):
                part = slice(start, start + WINDOWS)
                used, back = np.unique(at[part], return_inverse=True)

                def allowed(w, rows, used=used, back=back):
                    a = used[back[w]]
                    return ((labels[rows][None, :] == lab[a][:, None]) == same) & (ids[rows][None, :] != own[a][:, None])

                window, row, score = vptree.nearest(tree, x, ids, allowed, q[used], back, low[part], high[part], k, most)
                yield start, start + window, row, score

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, ids, labels = sample
            for batch in batches:
                at, tag, low, high = windows(batch.column("windows"))
                low = low.copy()
                for start, window, _, score in found(whole, x, ids, labels, batch, at, low, high):
                    count = np.bincount(window - start, minlength=1)
                    full = np.flatnonzero(count >= k)
                    low[start + full] = np.maximum(low[start + full], score[np.cumsum(count)[full] - 1])
                q = grid.unpack(batch.column("x"), width).astype(np.float64)
                least, greatest = tree.reach(np.concatenate((q, np.zeros((len(q), 1))), 1), (q * q).sum(1), most)
                meets = np.zeros(least.shape, bool)
                np.logical_or.at(meets, at, (greatest[at] >= low[:, None]) & (least[at] <= high[:, None]) & (low <= high)[:, None])
                size = np.array([blocks.get(c, 0) for c in range(least.shape[1])])
                row, cell = np.nonzero(meets)
                row, cell, block = np.repeat(row, size[cell]), np.repeat(cell, size[cell]), np.concatenate([np.arange(0), *(np.arange(size[c]) for c in cell)])
                narrowed = pa.ListArray.from_arrays(batch.column("windows").offsets, pa.StructArray.from_arrays([pa.array(tag), pa.array(low), pa.array(high)], names=["tag", "low", "high"])) if batch.num_rows else batch.column("windows")
                names = ["anchor", "vec_id", "label", "x"]
                for start in range(0, len(row), 8192):
                    take = pa.array(row[start : start + 8192])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), narrowed.take(take), pa.array(cell[start : start + 8192]), pa.array(block[start : start + 8192])], names=[*names, "windows", "cell", "block"])

        def meet(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
            names = ["anchor", "vec_id", "label", "tag", "top", "id", "score"]
            out = [pa.table([pa.array([], pa.int64())] * 7, names=names)]
            if rows.num_rows and asked.num_rows:
                asked = asked.combine_chunks().to_batches()[0]
                x, ids, labels = grid.unpack(rows.column("x"), width), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
                own = vptree.Tree(vptree.augmented(x, most), max(0, len(x) // LEAF).bit_length())
                at, tag, low, high = windows(asked.column("windows"))
                for _, window, row, score in found(own, x, ids, labels, asked, at, low, high):
                    take = pa.array(at[window])
                    out.append(pa.table([*(asked.column(c).take(take) for c in names[:3]), pa.array(tag[window]), pa.array(high[window]), pa.array(ids[row]), pa.array(score)], names=names))
            return pa.concat_tables(out)

        kind = "anchor long, vec_id long, label long, x binary, windows array<struct<tag: long, low: long, high: long>>, cell long, block long"
        asked = cluster.bounded_batches(anchors).select("anchor", "vec_id", "label", "x", "windows").mapInArrow(visit, kind).withColumn("part", F.pmod("anchor", F.lit(parts)))
        size = F.broadcast(self.spark.createDataFrame([(c, b) for c, b in blocks.items()], "cell long, blocks long"))
        rows = self.placed.join(size, "cell").withColumn("block", F.pmod(F.xxhash64("x", "label", "vec_id"), F.col("blocks"))).drop("blocks")
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        keys = ("cell", "block", "part")
        return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "anchor long, vec_id long, label long, tag long, top long, id long, score long")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80, vector: str = "embedding") -> DataFrame:
    """Hard negatives of vectors (vec_id, label, embedding); scores are inner products of floor(256 * component).

    Anchors are the rows whose vec_id is divisible by `every`. An anchor's positives are the `positives` rows of its label with the highest
    scores. For each of them: the `negatives` rows of another label with the highest scores from share / 100 of the positive's up to the positive's.
    Higher scores first, ties by smaller vec_id. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The search is exact: a block is left out only where no row in it can be in a window, and no cell, block or
    candidate list is cut. Equal vectors of a label keep the `positives` + 1 (or `negatives` + 1) smallest ids, as more
    can be in no result. Rows with a null vec_id or label, or a null, empty, non-finite or very large (2^18) vector take no part, nor do vectors of
    another length than the most common one. Repeated rows count once; rows of one vec_id that differ are rows of their own, but none is another's
    positive or negative. A positive with a negative score has no negatives, as its window is empty. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("v")).filter("vec_id is not null and label is not null")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    width = grid.width(rows, "v")
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    all_rows = Mine(grid.gridded(rows, "v", width), width, max(positives, negatives) + 1)
    anchors = grid.gridded(rows.filter(F.col("vec_id") % every == 0), "v", width).distinct().withColumn("anchor", F.xxhash64("vec_id", "label", "x"))
    anchors = cluster.written(anchors, "anchors")
    all_window = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.lit(-WIDEST).cast("long").alias("low"), F.lit(WIDEST).cast("long").alias("high")))
    near = all_rows.search(anchors.withColumn("windows", all_window), positives, same=True)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = cluster.written(near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= positives).select("anchor", F.col("id").alias("tag"), F.col("score").alias("high")), "positives")
    # the least whole score from share / 100 of the positive's on
    low = -F.floor(F.col("high") * F.lit(-share) / 100).cast("long")
    window = F.struct("tag", low.alias("low"), "high")
    asked = cluster.written(anchors.join(best.filter("high >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("windows")), "anchor"), "windows")
    hard = all_rows.search(asked, negatives, same=False)
    first = Window.partitionBy("anchor", "tag", "top").orderBy(F.desc("score"), "id")
    ranked = hard.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return ranked.select(F.col("vec_id").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """vectors with a wrong label, (label + 1) % 10, where vec_id is divisible by 7: rows to be found."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings where label is not null and embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda c: not isfinite(c))) = 0),
s as (
  select a.vec_id as anchor, b.vec_id as id, a.label = b.label as same, list_dot_product(a.x, b.x)::bigint as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor, id, score from s where same qualify row_number() over (partition by anchor order by score desc, id) <= 5),
n as (
  select p.anchor, p.id as positive, p.score as top, s.id, s.score, row_number() over (partition by p.anchor, p.id order by s.score desc, s.id) as rank
  from p join s on p.anchor = s.anchor and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor as anchor_id, positive as positive_id, rank::int as rank, id as negative_id, top as positive_score, score as negative_score from n where rank <= 5"""
