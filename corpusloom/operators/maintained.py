"""An index of files that is kept in step with them, in versions that readers see as a whole or not at all.

An update writes one immutable segment with what the changed files brought: their states, chunks, postings, vectors,
and the differences that they make to document frequencies and to the statistics, which therefore are sums over
segments. Chunks of earlier segments that changed, rejected or vanished files had are listed as dead, and readers
leave them out. So an update cuts, checks and tokenises only files that changed, and a search of the result equals that
of an index built afresh. Compaction merges the segments into one, from what they hold and without any text being read anew.

What an index consists of is said by its manifests, one row for each version: segments, model and dimension. The
newest one counts, and it is written last, so that a run that fails or is stopped leaves the version before in place
and the next run begins anew from there. A version can be written once only, so of two writers at a time the second
one fails. Nothing is overwritten or deleted: readers go on with the version that they opened.

A change of model (`rebuild`) embeds all live chunks in steps beside the index, which goes on answering. Steps that are
done are not done again when a stopped or cancelled rebuild is started again; what came meanwhile is embedded before
the swap, which checks that every chunk has a vector of the model's dimension.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.operators.chunking import first_chunks
from corpusloom.operators.incremental import changed, fingerprints
from corpusloom.operators.quality import CRITICAL, content_issues, gate
from corpusloom.sources.store import BROADCAST_BYTES, is_small, scratch, written

SCHEMAS = {
    "files": "segment string, path string, content_md5 string, rejected boolean, reasons string, place int",
    "chunks": "segment string, id string, source string, heading string, heading_path string, text string, line_start int, line_end int",
    "postings": "segment string, id string, dl int, terms array<string>, tfs array<int>",
    "vectors": "segment string, id string, vec array<double>",
    "terms": "term string, df long, cf long",
    "stats": "n_docs long, n_tokens long",
    "dead": "segment string, id string",
}
FLAG = "kind string, number int, steps int, folder string, at int"
VERSION = "version int, segments array<string>, model string, dim int, n_chunks long, n_dead long, what string"


@dataclass(frozen=True)
class Model:
    """A name, the length of its vectors, and embed: (id, text) and their postings (id, term, tf, dl) to (id, vec) for each id.

    of_rows: the same from postings as they are stored, a row a chunk (search.counted), for a model that needs nothing else.
    """

    name: str
    dim: int
    embed: Callable[[DataFrame, DataFrame], DataFrame]
    of_rows: Callable[[DataFrame], DataFrame] | None = None

    def vectors(self, texts: DataFrame, rows: DataFrame) -> DataFrame:
        return self.of_rows(rows) if self.of_rows else self.embed(texts, search.exploded(rows))


#: Counts of terms in buckets: needs no model file.
HASHED = Model("hashed-terms", search.BUCKETS, lambda texts, postings: search.hashed_embedding(postings), search.hashed_rows)


@dataclass(frozen=True)
class Version:
    """What a manifest says; number 0 is that of an index that was never written."""

    number: int = 0
    segments: tuple[str, ...] = ()
    model: str = ""
    dim: int = 0
    n_chunks: int = 0
    n_dead: int = 0
    what: str = ""


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all versions."""
    try:
        return spark.read.schema(VERSION).parquet(f"{path}/versions/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSION)


def current(spark: SparkSession, path: str) -> Version:
    row = versions(spark, path).orderBy(F.desc("version")).first()
    return Version(row["version"], tuple(row["segments"]), *row[2:]) if row else Version()


def _commit(spark: SparkSession, path: str, before: Version, segments: list[str], model: Model | None, n_chunks: int, n_dead: int, what: str) -> Version:
    name, dim = (model.name, model.dim) if model else (before.model, before.dim)
    v = Version(before.number + 1, tuple(segments), name, dim, n_chunks, n_dead, what)
    row = spark.createDataFrame([(v.number, list(v.segments), v.model, v.dim, v.n_chunks, v.n_dead, v.what)], VERSION)
    row.coalesce(1).write.mode("error").parquet(f"{path}/versions/{v.number:010d}")
    return v


def _table(spark: SparkSession, path: str, version: Version, name: str) -> DataFrame:
    if not version.segments:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(*[f"{path}/segments/{s}/{name}" for s in version.segments])


def _live(spark: SparkSession, path: str, version: Version, name: str) -> DataFrame:
    t = _table(spark, path, version, name)
    if not version.n_dead:
        return t
    return t.join(_dead(_table(spark, path, version, "dead"), version.n_dead), ["segment", "id"], "left_anti")


def _dead(dead: DataFrame, n: int) -> DataFrame:
    return dead.hint("broadcast" if n * 64 <= BROADCAST_BYTES else "merge")


def states(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """path, content_md5, rejected, reasons of each file that the index knows."""
    v = version or current(spark, path)
    newest = _table(spark, path, v, "files").groupBy("path").agg(F.max_by(F.struct("content_md5", "rejected", "reasons"), "place").alias("s"))
    return newest.where("s.content_md5 IS NOT NULL").select("path", "s.*")


def opened(spark: SparkSession, path: str, version: Version | None = None) -> search.Index:
    """The index for searches: of the newest version, or of another one."""
    v = version or current(spark, path)
    terms = _table(spark, path, v, "terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    total = _table(spark, path, v, "stats").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    stats = total.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("n_tokens") / F.col("n_docs")))
    chunks, rows, vectors = (_live(spark, path, v, name).drop("segment") for name in ("chunks", "postings", "vectors"))
    return search.Index(chunks, search.exploded(rows), terms, stats, vectors, rows)


def _write(df: DataFrame, folder: str, name: str) -> DataFrame:
    kinds = [f.strip().split(" ") for f in SCHEMAS[name].split(", ")]
    search.stored(df.select(*[F.col(c).cast(kind) for c, kind in kinds]), f"{folder}/{name}", "error")
    return df.sparkSession.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def update(files: DataFrame, path: str, model: Model = HASHED, force: bool = False, present: DataFrame | None = None) -> DataFrame:
    """Brings the index below path in step with files (path, text), and returns the run's statistics, one row.

    The row has files_seen, files_new, files_modified, files_unchanged, files_rejected (all that are now),
    files_removed, chunks_added, chunks_removed and version. Files with critical issues are known with their reasons and have no chunks; of repeated
    paths one row counts (the greatest digest); rows with a null path or text are not files. If there are no files at
    all, nothing changes, as a failed scan must not empty an index. force: all files are taken as changed. present: the
    paths (path) of all files that there are, where files holds only those that may have changed; others stay as they are.
    """
    spark = files.sparkSession
    before = current(spark, path)
    if before.number and before.segments and (before.model, before.dim) != (model.name, model.dim):
        raise ValueError(f"the index has vectors of {before.model} ({before.dim}); rebuild it for {model.name} ({model.dim})")
    name = f"{before.number + 1:010d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/segments/{name}"
    f = files.where("path IS NOT NULL AND text IS NOT NULL").select("path", "text")
    known = states(spark, path, before)
    now = fingerprints(f, "path", "text").groupBy("path").agg(F.max("content_md5").alias("content_md5"))
    if present is not None:
        same = known.select("path", "content_md5").join(present.select("path").distinct(), "path", "left_semi").join(f.select("path").distinct(), "path", "left_anti")
        now = now.unionByName(same)
    now = written(now, "fingerprints")
    n_now = now.count()
    diff = now if force else changed(now, known)
    # only the changed files' texts go on from here
    new = _picked(f.withColumn("content_md5", F.md5("text")), written(diff.select("path", "content_md5"), "diff"), not known.take(1))
    named = new.select(F.col("path").alias("file"), "text")
    _, why = gate(named, content_issues(named, rules=CRITICAL))
    state = new.select("path", "content_md5").join(why.select(F.col("file").alias("path"), "reasons"), "path", "left")
    state = state.select("path", "content_md5", F.col("reasons").isNotNull().alias("rejected"), "reasons")
    gone = known.join(now, "path", "left_anti").select("path", F.lit(None).cast("string").alias("content_md5"), F.lit(False).alias("rejected"), F.lit(None).cast("string").alias("reasons"))
    state = state.unionByName(gone) if n_now else state
    state = _write(state.withColumn("segment", F.lit(name)).withColumn("place", F.lit(before.number + 1)), folder, "files")

    kept = _without(new, state.where("rejected").select("path"))
    cut = first_chunks(kept, "path", "text").withColumnRenamed("chunk_id", "id")
    chunks = _write(cut.withColumn("segment", F.lit(name)), folder, "chunks")
    dead = _live(spark, path, before, "chunks").select("segment", "id", "source").join(state.select(F.col("path").alias("source")), "source", "left_semi")
    dead = _write(dead, folder, "dead")
    rows = _write(search.counted(chunks, "id", "text").withColumn("segment", F.lit(name)), folder, "postings")
    post = search.exploded(rows)
    _write(model.vectors(chunks.select("id", "text"), rows.drop("segment")).withColumn("segment", F.lit(name)), folder, "vectors")
    n_dead, n_new = dead.count(), chunks.count()
    lost = search.exploded(_table(spark, path, before, "postings").join(_dead(dead, n_dead), ["segment", "id"], "left_semi"))
    both = post.select("term", F.lit(1).alias("n"), "tf").unionByName(lost.select("term", F.lit(-1).alias("n"), (-F.col("tf")).alias("tf")))
    terms = _write(both.groupBy("term").agg(F.sum("n").alias("df"), F.sum("tf").alias("cf")).where("df <> 0 OR cf <> 0"), folder, "terms")
    tokens = terms.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"))
    _write(tokens.withColumn("n_docs", F.lit(n_new - n_dead)), folder, "stats")

    after = before
    if not before.number or state.take(1):
        after = _commit(spark, path, before, [*before.segments, name], model, before.n_chunks + n_new - n_dead, before.n_dead + n_dead, "update")
    return _run(spark, path, now, known, after, n_now, n_new, n_dead)


def _picked(files: DataFrame, wanted: DataFrame, every: bool) -> DataFrame:
    """Of files (path, text, content_md5) those that are wanted (path, content_md5), each once, as written.

    Texts stay where they are: rows are found by 64 bits, and paths and digests of what was found are compared afterwards.
    Only if something is there that isn't wanted, or twice, texts are moved. every: all files are wanted, repeated paths apart.
    """
    code = F.xxhash64("path", "content_md5")
    codes = wanted.select(code.alias("_code"))
    if every:
        some = files
    elif is_small(codes, F.lit(16)):
        some = files.withColumn("_code", code).join(F.broadcast(codes), "_code", "left_semi").drop("_code")
    else:
        some = files.join(wanted.hint("merge"), ["path", "content_md5"], "left_semi")
    path = scratch(files.sparkSession, "changed")
    search.stored(some, path)
    some = files.sparkSession.read.schema(some.schema).parquet(path)
    found = some.groupBy("path", "content_md5").count()
    odd = found.join(wanted.withColumn("one", F.lit(1)), ["path", "content_md5"], "left").where("count > 1 OR one IS NULL")
    if odd.take(1):
        return written(some.join(wanted.hint("merge"), ["path", "content_md5"], "left_semi").dropDuplicates(["path"]), "once")
    return some


def _without(files: DataFrame, gone: DataFrame) -> DataFrame:
    """files without those whose path is among the gone: by 64 bits of it, if these are few enough and no other file has the same."""
    code = F.xxhash64("path").alias("_code")
    gone = written(gone.select("path", code), "rejected")
    if is_small(gone, F.lit(16)):
        clash = files.select(F.col("path").alias("other"), code).join(gone, "_code").where("path <> other")
        if not clash.take(1):
            return files.withColumn("_code", code).join(F.broadcast(gone.select("_code")), "_code", "left_anti").drop("_code")
    return files.join(gone.select("path").hint("merge"), "path", "left_anti")


def _run(spark: SparkSession, path: str, now: DataFrame, known: DataFrame, after: Version, n_now: int, n_new: int, n_dead: int) -> DataFrame:
    is_ = states(spark, path, after).select("path", "rejected")
    j = now.join(known.select("path", F.col("content_md5").alias("old"), F.col("rejected").alias("was_rejected")), "path", "full_outer").join(is_, "path", "left")
    here, no = F.col("content_md5").isNotNull(), F.coalesce("rejected", F.lit(False))
    old = F.col("old").isNotNull() & ~F.coalesce("was_rejected", F.lit(False))  # had chunks before
    return j.agg(
        F.count_if(here).alias("files_seen"), F.count_if(here & ~no & ~old).alias("files_new"), F.count_if(here & ~no & old & (F.col("old") != F.col("content_md5"))).alias("files_modified"),
        F.count_if(here & ~no & old & (F.col("old") == F.col("content_md5"))).alias("files_unchanged"), F.count_if(here & no).alias("files_rejected"),
        F.when(F.lit(n_now > 0), F.count_if(~here & old)).otherwise(F.lit(0)).cast("long").alias("files_removed"),
        F.lit(n_new).cast("long").alias("chunks_added"), F.lit(n_dead).cast("long").alias("chunks_removed"), F.lit(after.number).alias("version"),
    )


def _merged(spark: SparkSession, path: str, v: Version, name: str, vectors: DataFrame | None = None) -> int:
    """Writes one segment of all that is live in a version; returns how many chunks it has."""
    folder = f"{path}/segments/{name}"
    index = opened(spark, path, v)
    own = lambda d: d.withColumn("segment", F.lit(name))
    _write(own(states(spark, path, v)).withColumn("place", F.lit(v.number + 1)), folder, "files")
    n = _write(own(index.payload), folder, "chunks").count()
    _write(own(index.counted), folder, "postings")
    _write(own(index.vectors if vectors is None else vectors), folder, "vectors")
    _write(index.terms, folder, "terms")
    _write(index.stats, folder, "stats")
    _write(spark.createDataFrame([], SCHEMAS["dead"]), folder, "dead")
    return n


def compact(spark: SparkSession, path: str) -> Version:
    """The index as one segment without dead rows, as a new version."""
    v = current(spark, path)
    if len(v.segments) < 2:
        return v
    name = f"{v.number + 1:010d}-{uuid.uuid4().hex[:8]}"
    n = _merged(spark, path, v, name)
    if n != v.n_chunks:
        raise RuntimeError(f"{n} chunks of {v.n_chunks} were merged; the index stays as it was")
    return _commit(spark, path, v, [name], None, n, 0, "compact")


def clear(spark: SparkSession, path: str) -> Version:
    """An empty index as a new version: the next update indexes all files, with any model."""
    v = current(spark, path)
    return _commit(spark, path, v, [], None, 0, 0, "clear")


# a change of model


def _shadow(path: str, model: Model) -> str:
    return f"{path}/shadows/{model.name}-{model.dim}"


def _flags(spark: SparkSession, path: str, model: Model) -> DataFrame:
    """kind (step, cancel, resume, swap), number, folder and at, the order, of all that happened to a rebuild."""
    schema = FLAG
    try:
        return spark.read.schema(schema).parquet(f"{_shadow(path, model)}/flags")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _flag(spark: SparkSession, path: str, model: Model, kind: str, number: int = 0, steps: int = 0, folder: str = "") -> None:
    at = (_flags(spark, path, model).agg(F.max("at")).first()[0] or 0) + 1
    spark.createDataFrame([(kind, number, steps, folder, at)], FLAG).coalesce(1).write.mode("append").parquet(f"{_shadow(path, model)}/flags")


def cancel(spark: SparkSession, path: str, model: Model) -> None:
    """Asks a rebuild, wherever it runs, to end before its next step."""
    _flag(spark, path, model, "cancel")


def _cancelled(spark: SparkSession, path: str, model: Model) -> bool:
    last = _flags(spark, path, model).where("kind IN ('cancel', 'resume', 'swap')").orderBy(F.desc("at")).first()
    return last is not None and last["kind"] == "cancel"


def rebuild_status(spark: SparkSession, path: str, model: Model) -> DataFrame:
    """One row: model, status (idle, building, cancelled, done), steps_done, steps, percent."""
    f = _flags(spark, path, model)
    since = F.coalesce(F.max(F.when(F.col("kind") == "swap", F.col("at"))), F.lit(0)).alias("swapped")
    word = F.when(F.col("kind") != "step", F.col("kind"))  # a step that was under way when a cancel came still ends
    last = F.max_by(word, F.when(word.isNotNull(), F.col("at"))).alias("last")
    head = f.agg(since, last, F.max_by(F.when(F.col("steps") > 0, F.col("steps")), F.when(F.col("steps") > 0, F.col("at"))).alias("steps"))
    at_work = f.crossJoin(F.broadcast(head.select("swapped"))).where("kind = 'step' AND at > swapped").agg(F.count_distinct("number").alias("n"))  # one row
    done = F.when(F.col("last") == "swap", F.col("steps")).otherwise(F.col("n"))
    status = F.when(F.col("last").isNull(), "idle").when(F.col("last") == "swap", "done").when(F.col("last") == "cancel", "cancelled").otherwise("building")
    return head.crossJoin(at_work).select(F.lit(model.name).alias("model"), status.alias("status"), done.cast("long").alias("steps_done"), F.col("steps").cast("long").alias("steps"), F.bround(done / F.col("steps") * 100).cast("long").alias("percent"))


def rebuild(spark: SparkSession, path: str, model: Model, steps: int = 8) -> Version:
    """The index with another model's vectors, as a new version; the one before answers until then, and for good if this is cancelled.

    Started again after a stop or a cancel, it goes on with the steps that are not done. `steps` stays what it was when it began.
    """
    shadow = _shadow(path, model)
    f = _flags(spark, path, model)
    swapped = f.where("kind = 'swap'").agg(F.max("at")).first()[0] or 0
    done = {(r["number"], r["steps"]): r["folder"] for r in f.where(F.col("kind") == "step").where(F.col("at") > swapped).collect()}  # a row for each step
    steps = next(iter(done))[1] if done else steps
    _flag(spark, path, model, "resume", steps=steps)
    paths = list(done.values())

    def embedded(chunks: DataFrame, rows: DataFrame, what: str) -> str:
        to = f"{shadow}/{what}-{uuid.uuid4().hex[:8]}"
        model.vectors(chunks, rows).select("id", F.col("vec").cast("array<double>").alias("vec")).write.mode("error").parquet(to)
        return to

    for number in range(steps):
        if (number, steps) in done:
            continue
        if _cancelled(spark, path, model):
            return current(spark, path)
        index = opened(spark, path)
        mine = F.pmod(F.xxhash64("id"), F.lit(steps)) == number
        paths.append(embedded(index.payload.where(mine).select("id", "text"), index.counted.where(mine), f"step-{number}"))
        _flag(spark, path, model, "step", number, steps, paths[-1])
    if _cancelled(spark, path, model):
        return current(spark, path)
    v = current(spark, path)
    index = opened(spark, path, v)
    ready = spark.read.schema("id string, vec array<double>").parquet(*paths)
    late = index.payload.select("id", "text").join(ready.select("id"), "id", "left_anti")  # what came since its step was done
    last = embedded(late := written(late, "late"), index.counted.join(late.select("id"), "id", "left_semi"), "late")
    ready = spark.read.schema("id string, vec array<double>").parquet(*paths, last)
    vectors = ready.join(index.payload.select("id"), "id", "left_semi").dropDuplicates(["id"])
    name = f"{v.number + 1:010d}-{uuid.uuid4().hex[:8]}"
    n = _merged(spark, path, v, name, vectors)
    found = stored_dimensions(spark, path, Version(v.number, (name,))).collect()
    if n != v.n_chunks or any(r["dim"] != model.dim for r in found):
        raise RuntimeError(f"{n} chunks of {v.n_chunks}, vectors of {[r['dim'] for r in found]} for {model.dim}; the index stays as it was")
    after = _commit(spark, path, v, [name], model, n, 0, "rebuild")
    _flag(spark, path, model, "swap", steps=steps)
    return after


def stored_dimensions(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """dim, n: the lengths of the vectors that a version has."""
    return _live(spark, path, version or current(spark, path), "vectors").groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))


def healed(spark: SparkSession, path: str, model: Model) -> search.Index:
    """The index for searches with a model: rebuilt first if its vectors are another model's or of another length."""
    v = current(spark, path)
    if v.segments and ((v.model, v.dim) != (model.name, model.dim) or any(r["dim"] != model.dim for r in stored_dimensions(spark, path, v).collect())):
        rebuild(spark, path, model)
    return opened(spark, path)
