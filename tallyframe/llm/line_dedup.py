"""Line dedup: levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import bucketed, discard, ordered_scans, written
from .text import SPACE, lines, lower_ascii, whole

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


#: Lines of a bucket and of a batch, about; and buckets that Spark allows.
BUCKET_LINES, BATCH_LINES, MAX_BUCKETS = 4_000_000, 50_000_000_000, 100_000
#: A key in more than one of so many lines is a hot one: there are at most as many of them.
HOT_SHARE = 10_000


class LineRuns:
    """A log-structured index of line hashes.

    Each run is a table ``h1, h2, docs, lines, last_doc`` in buckets by hash, each sorted; a key stands in
    one run only. A new batch, in the same buckets, is merged against the runs one by one, without exchange or sort: keys that
    no run has (anti join) become a run of level 0; of the others (semi join) the batch's
    counts are kept beside the runs. ``fanout`` runs of a level are compacted into
    one of the next level, so a key is rewritten once a level.
    """

    def __init__(self, buckets: int, fanout: int = 3):
        self.buckets, self.fanout, self.levels, self.again = buckets, fanout, [[]], []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def run(self, rows: DataFrame) -> DataFrame:
        return bucketed(rows, "line-run", KEY, self.buckets)

    @staticmethod
    def merged(batch: DataFrame, run: DataFrame, how: str) -> DataFrame:
        return batch.join(run.select(*KEY).hint("merge"), KEY, how)

    def add(self, counted: DataFrame, last: bool = False) -> None:
        """Merge a batch with the runs; after the ``last`` one nothing is compacted, as no batch follows that would read fewer runs."""
        batch = self.run(counted)
        runs = self.runs()
        if runs:
            with ordered_scans(batch.sparkSession):
                fresh = self.run(reduce(lambda left, run: self.merged(left, run, "left_anti"), runs, batch))
                self.again.append(written(reduce(DataFrame.unionByName, [self.merged(batch, run, "left_semi") for run in runs]), "line-again"))
            discard(batch)
        else:
            fresh = batch
        self.levels[0].append(fresh)
        for k in range(0 if last else len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self.run(reduce(DataFrame.unionByName, self.levels[k])))
                discard(*self.levels[k])
                self.levels[k] = []

    def totals(self) -> DataFrame:
        """Documents, lines and last document of each key over all batches."""
        everything = reduce(DataFrame.unionByName, self.runs())
        if not self.again:
            return everything
        more = reduce(DataFrame.unionByName, self.again).groupBy(*KEY).agg(F.sum("docs").alias("more"), F.sum("lines").alias("longer"), F.max("last_doc").alias("later"))
        added = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
        return everything.join(more, KEY, "left").select(*KEY, added("docs", "more"), added("lines", "longer"), F.greatest("last_doc", "later").alias("last_doc"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """Drop lines that recur across documents, but for those of the largest id.

    A line's key is the line stripped and A-Z lower-cased; keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents lose their lines in
    all documents except in that with the largest id. Returns all columns of
    ``docs`` with the text that stays, and ``n_lines`` (before) and ``n_dropped``.

    Keys are compared by two 64-bit hashes. There is at least one batch more than ``fanout``, so that the last one merges with a compacted run instead of ``fanout`` small ones, and more so that none has over BATCH_LINES lines; they are dealt by a hash of the id, so
    all rows of a document fall into one batch. Lines with a hot key, in more than one of HOT_SHARE lines, meet a broadcast table of these at most HOT_SHARE keys; all others
    meet theirs in a join in which no key has more lines than that. Null or empty text is one empty line and
    stays as it is, null as empty; rows with equal id count as one document and
    each keeps its row; a null id counts as one document, smaller than all.
    ``n_lines`` and ``n_dropped`` replace columns of those names; names that begin with ``__tf_`` are
    taken, here and in the other operators.
    """
    id_, text = F.col(id_col), whole(text_col)
    light = written(
        docs.select(id_.alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(lines(text)).alias("pos", "line"))
        .select("doc", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "line-hashes",
    )
    lines_ = light.count()  # from the footers
    batches = batches or max(fanout + 1, -(-lines_ // BATCH_LINES))
    index = LineRuns(min(MAX_BUCKETS, max(8, -(-lines_ // BUCKET_LINES))), fanout)
    for b in range(batches):
        batch = light.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b)
        in_doc = batch.groupBy(*KEY, "doc").agg(F.count("*").alias("lines"))
        index.add(in_doc.groupBy(*KEY).agg(F.count("*").alias("docs"), F.sum("lines").alias("lines"), F.max("doc").alias("last_doc")), last=b == batches - 1)
    common = written(index.totals().where(F.col("docs") >= min_docs), "line-common")
    discard(*index.runs(), *index.again)
    hot = F.col("lines") * HOT_SHARE > lines_  # however few documents they are in
    frequent = F.broadcast(common.where(hot).select(*KEY, "last_doc"))  # at most HOT_SHARE keys
    rest = light.join(frequent.select(*KEY), KEY, "left_anti").join(common.where(~hot).select(*KEY, "last_doc"), KEY)
    gone = light.join(frequent, KEY).select(*rest.columns).unionByName(rest).where(~F.col("doc").eqNullSafe(F.col("last_doc")))
    dropped = gone.groupBy(F.col("doc").alias("__tf_doc"), F.col("th").alias("__tf_th")).agg(F.collect_set("pos").alias("__tf_drop"))
    clash = [c for c in ("n_lines", "n_dropped") if c in docs.columns]
    rows = docs.drop(*clash)
    joined = rows.join(dropped, rows[id_col].eqNullSafe(F.col("__tf_doc")) & (F.xxhash64(whole(rows[text_col])) == F.col("__tf_th")), "left")
    split = joined.withColumn("__tf_lines", lines(text))
    drop = F.col("__tf_drop")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__tf_lines") - 1), drop)
    kept = F.when(drop.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__tf_lines"), i)), "\n"))
    out = split.select(*rows.columns, kept.alias("__tf_kept"), F.size("__tf_lines").cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(*[F.col("__tf_kept").alias(c) if c == text_col else F.col(c) for c in rows.columns], "n_lines", "n_dropped")
