"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A batch of changes has one row per event: ``insert`` (a document's count under a
tokenizer version), ``delete`` (takes an earlier insert back) and ``revise`` (old count
out, new count in).  ``deltas`` turns events into signed rows, ``Rollup.apply`` adds one
batch's aggregated deltas as a Parquet folder named by the batch id.  A folder counts
only once its ``_SUCCESS`` marker is there and a batch id that is already committed is
skipped, so a batch that is replayed, or whose job died half way, never counts twice.
Totals are the sum of all live folders.  ``compact`` folds them into one: it writes the
folded rows, then the list of the batches they replace, whose marker makes both count at
once; only then the replaced folders go.  A job that dies in between loses nothing.  One
process writes to a store at a time.

Defined cases: null source or lang are groups of their own; null and empty texts are one
text and count 0 tokens; repeated rows count each time, until the query deletes all copies
of a text but one (the smallest doc_id, a null one last); an empty batch commits no rows;
groups whose documents and tokens are back at zero vanish from the totals; extra columns
are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
WORDS = "words-1"  # white-space words, in SQL
BPE = "byte_bpe_50k"


def count_bpe(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """The kept columns and ``n_tokens``, ids of the byte-level BPE of each whole text."""
    schema = docs.select(*keep).schema.add("n_tokens", "long")

    def run(batches):
        encode = tokens.encoder(path)
        for b in C.chunks(batches, limit=4 << 20):
            n = [len(encode(t)) // 4 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def words(text) -> F.Column:
    """Number of words [^ \\t-\\r]+ of a text column, 0 for null."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long")


def deltas(events: DataFrame) -> DataFrame:
    """Signed sums of a batch of events.

    events: action (insert, delete, revise), source, lang, tokenizer, n_tokens, n_chars
    and, for revise, old_tokens and old_tokenizer (null: the same tokenizer), old_chars.
    A column ``times``, if there is one, says for how many equal events a row stands (null: 1).
    """
    times = F.coalesce("times", F.lit(1)) if "times" in events.columns else F.lit(1)
    events = events.withColumn("times", times)
    plus = events.where("action in ('insert', 'revise')").select(*KEYS, F.col("times").alias("s"), "n_tokens", "n_chars")
    gone = events.where("action = 'delete'").select(*KEYS, F.negative("times").alias("s"), "n_tokens", "n_chars")
    old = events.where("action = 'revise'").select("source", "lang", F.coalesce("old_tokenizer", "tokenizer").alias("tokenizer"), F.negative("times").alias("s"), F.col("old_tokens").alias("n_tokens"), F.coalesce("old_chars", "n_chars").alias("n_chars"))
    rows = plus.unionByName(gone).unionByName(old)
    add = lambda c, a: F.coalesce(F.sum(F.col("s") * F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(a)
    return rows.groupBy(*KEYS).agg(F.sum("s").cast("long").alias("docs"), add("n_tokens", "tokens"), add("n_chars", "chars"))


class Rollup:
    """A store of committed delta batches under ``path`` (any filesystem Spark can write)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, name: str) -> bool:
        return self._fs.exists(self._p(f"{self.path}/{name}/_SUCCESS"))

    def _state(self) -> tuple[list[str], set[str]]:
        """(folders that count, names of all folders that count or were folded into one)."""
        if not self._fs.exists(self._p(self.path)):
            return [], set()
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(self.path)) if s.isDirectory()]
        folds = [n for n in names if n.startswith("fold=") and self._done(f"{n}/replaces")]
        lists = [f"{self.path}/{n}/replaces" for n in folds]
        gone = {r.name for r in self.spark.read.schema("name string").parquet(*lists).collect()} if lists else set()  # one row per batch
        there = folds + [n for n in names if n.startswith("batch=") and self._done(n)]
        return sorted(n for n in there if n not in gone), gone | set(there)

    def committed(self) -> list[str]:
        """Ids of all batches that count, folded ones too."""
        return sorted(n.removeprefix("batch=") for n in self._state()[1] if n.startswith("batch="))

    def apply(self, batch_id: str, events: DataFrame) -> bool:
        """Commit one batch; False where that id is committed already."""
        if batch_id in self.committed():
            return False
        out = deltas(events).coalesce(8)
        # overwrite replaces what a failed attempt at the same batch left behind
        out.write.mode("overwrite").parquet(f"{self.path}/{_name('batch', batch_id)}")
        return True

    def _rows(self, live: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}/rows" if n.startswith("fold=") else f"{self.path}/{n}" for n in live]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = [F.sum(c).cast("long").alias(c) for c in ("docs", "tokens", "chars")]
        return rows.groupBy(*KEYS).agg(*sums).where("docs <> 0 or tokens <> 0 or chars <> 0")

    def totals(self) -> DataFrame:
        return self._rows(self._state()[0])

    def compact(self, fold_id: str) -> bool:
        """Fold all that counts into one folder; False where a fold of that id is there already.

        Folds and batches have ids of their own; the batches stay known, so they are
        still refused when sent again.
        """
        live, known = self._state()
        name = _name("fold", fold_id)
        if name in known:
            return False
        self._rows(live).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/rows")
        replaced = self.spark.createDataFrame([(n,) for n in sorted(known)], "name string")
        replaced.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/replaces")  # its marker commits
        self.sweep()
        return True

    def sweep(self) -> None:
        """Delete folders that a fold has replaced, also those a job that died left."""
        live, known = self._state()
        for n in known - set(live):
            self._fs.delete(self._p(f"{self.path}/{n}"), True)


def _name(kind: str, own: str) -> str:
    if not own or "/" in own:
        raise ValueError(f"no id of a {kind}: {own!r}")
    return f"{kind}={own}"


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Totals of `documents` after four batches, one of them sent twice."""
    return count_documents(C.table(spark, sf_dir, "documents"), path)


def count_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Totals by source, lang and tokenizer after these batches.

    load: every document under both tokenizers; recount: the word counts are revised to
    a second version that leaves out words without a letter; dedup: of equal texts all
    but one are deleted under both; load again: ignored, as committed.
    """
    spark = docs.sparkSession
    docs = C.columns_of(docs, "doc_id", "text", "source", "lang")
    text = F.coalesce("text", F.lit(""))
    lettered = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*", "\u0001"), "[^\u0001]", "")
    docs = docs.withColumns({"n_chars": F.length(text).cast("long"), "w1": words(F.col("text")), "w2": F.length(lettered).cast("long"), "h": F.sha2(text, 256)})
    counted = C.cut(count_bpe(docs, path or tokens.default_path(), "doc_id", "source", "lang", "n_chars", "w1", "w2", "h"), "counted")
    both = F.explode(F.array(F.struct(F.lit(BPE).alias("tokenizer"), F.col("n_tokens").alias("n")), F.struct(F.lit(WORDS).alias("tokenizer"), F.col("w1").alias("n"))))
    load = counted.select("source", "lang", "n_chars", both.alias("e")).select(F.lit("insert").alias("action"), "source", "lang", "e.tokenizer", F.col("e.n").alias("n_tokens"), "n_chars", *_old())
    recount = counted.select(F.lit("revise").alias("action"), "source", "lang", F.lit("words-2").alias("tokenizer"), F.col("w2").alias("n_tokens"), "n_chars", F.lit(WORDS).alias("old_tokenizer"), F.col("w1").alias("old_tokens"), F.col("n_chars").alias("old_chars"))
    # equal texts collapse by group before they meet, so no text is a hot key
    id_ = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang")
    sums = [F.first(c).alias(c) for c in ("n_chars", "n_tokens", "w2")]
    per = counted.groupBy("h", "source", "lang").agg(F.count("*").alias("n"), F.min(id_).alias("least"), *sums)
    first = per.groupBy("h").agg(F.min("least").alias("keep"), F.sum("n").alias("all")).where("all > 1")
    stays = (F.col("least") == F.col("keep")).cast("long")
    copies = per.join(first, "h").withColumn("times", F.col("n") - stays).where("times > 0")
    both2 = F.explode(F.array(F.struct(F.lit(BPE).alias("tokenizer"), F.col("n_tokens").alias("n")), F.struct(F.lit("words-2").alias("tokenizer"), F.col("w2").alias("n"))))
    dedup = copies.select("source", "lang", "n_chars", "times", both2.alias("e")).select(F.lit("delete").alias("action"), "source", "lang", "e.tokenizer", F.col("e.n").alias("n_tokens"), "n_chars", "times", *_old())
    store = Rollup(spark, C.own_path(spark, "rollup"))
    for name, events in (("load", load), ("recount", recount), ("dedup", dedup), ("load", load)):
        store.apply(name, events)
    return store.totals()


def _old() -> list:
    return [F.lit(None).cast("string").alias("old_tokenizer"), F.lit(None).cast("long").alias("old_tokens"), F.lit(None).cast("long").alias("old_chars")]
