"""What the two exact span deduplications share: runs of windows meet by anchor, and removed spans go back to their documents.

A run is a row (anchor, content, doc, start, n): n windows of a document from unit `start` on that
share an anchor. Runs of one content in one slice of a task travel as one row, the later ones as a list
beside the first; so a content that fills a third of the corpus is a row per slice, not per document. Where runs
meet, contents that repeat within slices are a row each, aggregated before the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import map_slices, text_bytes
from .superwindows import Spans, signed

#: Bytes of text in a slice; the hashes of a slice take some eighty bytes a byte.
RUN_BYTES = 1 << 20
RUN = "anchor long, content long, doc long, start int, n int, more array<struct<doc:long,start:int>>"
DIGESTED = f"{RUN}, digest binary"
MORE = pa.list_(pa.struct([("doc", pa.int64()), ("start", pa.int32())]))


def run_batch(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Runs of a slice, those of one anchor and content in one row behind the first of them."""
    order = np.lexsort((start, doc, content, anchor))
    anchor, content, doc, start, n = (x[order] for x in (anchor, content, doc, start, n))
    lead = np.ones(len(anchor), bool)
    lead[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    group = np.cumsum(lead) - 1
    counts = np.bincount(group) - 1 if len(group) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    rest = pa.StructArray.from_arrays([pa.array(doc[~lead]), pa.array(start[~lead].astype(np.int32))], ["doc", "start"])
    more = pa.ListArray.from_arrays(pa.array(offsets), rest, mask=pa.array(counts == 0))
    columns = [signed(anchor[lead]), signed(content[lead]), pa.array(doc[lead]), pa.array(start[lead].astype(np.int32)), pa.array(n[lead].astype(np.int32)), more]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "content", "doc", "start", "n", "more"])


def meet(runs: DataFrame, removed: Callable[[Column, Column], Column], asked: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows (anchor, crowd, doc, start, n, content, source, source_start) of the runs that share an anchor with others.

    removed(run, first) tells for a run, a struct of doc and start, and the first run of its content,
    its source, whether all its windows go; these rows have no anchor. asked(run, first) tells whether a run stands
    for its content where contents differ; these rows have the anchor and the number of rows (crowd)
    that met there.
    """
    by_anchor, by_content = Window.partitionBy("anchor"), Window.partitionBy("anchor", "content")
    own = F.struct("doc", "start")
    # What repeats within slices may fill the corpus: one row stands for all of it where runs meet, and what it finds is joined back.
    runs = written(runs)
    many = written(runs.where(F.col("more").isNotNull()))
    one = many.groupBy("anchor", "content").agg(F.min(own).alias("own"), F.min("n").alias("n"), F.count("*").alias("rows"))
    one = one.select("anchor", "content", "own.doc", "own.start", "n", "rows", F.lit(True).alias("hot"))
    rest = runs.where(F.col("more").isNull()).select("anchor", "content", "doc", "start", "n", F.lit(1).cast("long").alias("rows"), F.lit(False).alias("hot"))
    rows = rest.unionByName(one).withColumn("first", F.first(own).over(by_content.orderBy("doc", "start")))
    rows = rows.withColumns({"crowd": F.sum("rows").over(by_anchor), "low": F.min("content").over(by_anchor), "high": F.max("content").over(by_anchor)})
    rows = rows.withColumns({"mixed": F.col("low") != F.col("high"), "run": own})

    goes = removed(F.col("run"), F.col("first"))
    wanted = goes | (F.col("mixed") & asked(F.col("run"), F.col("first")))

    def found(rows: DataFrame) -> DataFrame:
        places = [F.col("run.doc").alias("doc"), F.col("run.start").alias("start"), "n", "content", F.col("first.doc").alias("source"), F.col("first.start").alias("source_start")]
        return rows.select(F.when(~goes, F.col("anchor")).alias("anchor"), "crowd", *places)

    rows = written(rows.where(F.col("hot") | ((F.col("crowd") > 1) & wanted)).select("anchor", "content", "n", "hot", "first", "crowd", "mixed", "run"))
    discard(runs)
    facts = rows.where("hot").select("anchor", "content", "first", "crowd", "mixed")
    each = many.join(facts, ["anchor", "content"]).select("anchor", "content", "n", "first", "crowd", "mixed", F.explode(F.concat(F.array(own), "more")).alias("run"))
    return found(rows.where(~F.col("hot")).drop("hot")).unionByName(found(each.where(wanted)))


CLAIM = ("source", "source_start", "n")


def claims(gone: DataFrame) -> DataFrame:
    """doc, start, n, source, source_start: neighbouring runs that go, as one wherever their sources are neighbours too."""
    by_start = Window.partitionBy("doc").orderBy("start", "content")
    before = F.lag(F.struct(F.col("source").alias("source"), (F.col("source_start") + F.col("n")).alias("source_start"), (F.col("start") + F.col("n")).alias("start"))).over(by_start)
    goes_on = before == F.struct("source", "source_start", "start")
    islands = gone.withColumn("lead", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("lead").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = islands.groupBy("doc", "island").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("source").alias("source"), F.min("source_start").alias("source_start"))
    return joined.drop("island")


def sources(claimed: DataFrame) -> DataFrame:
    """doc, start, n: the places that claims name as their sources, each once."""
    return claimed.select(F.col("source").alias("doc"), F.col("source_start").alias("start"), "n").distinct()


def witnessed(claimed: DataFrame, digests: DataFrame) -> DataFrame:
    """The claims with the digest of what stands at their source. digests: doc, start, n, digest."""
    seen = digests.select(F.col("doc").alias("source"), F.col("start").alias("source_start"), "n", "digest")
    return claimed.join(seen, [*CLAIM]).select("doc", "start", "n", F.lit(0).cast("long").alias("content"), "digest")


def written(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again."""
    path = f"{shared_folder(frame.sparkSession)}/prismatic-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    found = frame.sparkSession.read.schema(frame.schema).parquet(path)
    found.written_to = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete the files of written frames that nothing reads any more: all that was made from them is written itself."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_document(spans: DataFrame, *columns: str) -> DataFrame:
    return spans.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct(*columns)).alias("spans"))


def merged(start: np.ndarray, n: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the union of windows' units starts and ends, within size units."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(size + 1, np.int32)
    start, end = np.minimum(start, size), np.minimum(start + n - 1 + window, size)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change)[:size] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def list_slices(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and the fields' numbers of a list-of-struct column; null lists are empty."""
    counts = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    flat = pc.list_flatten(column)
    return np.concatenate([[0], np.cumsum(counts)]), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def own_runs(spans: Callable[[], Spans], begin: np.ndarray, end: np.ndarray, column: pa.Array, window: int, digest: Callable[[int, int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, starts and numbers of windows of the runs in a column of lists, by text.

    Only those that the text (from begin to end of the units) holds: what stands there must have the
    digest of what stands at the run's source, or the content that the run was found by. Where texts
    share an id, each has the runs of all of them in its list.
    """
    offsets, (start, n, content, seen) = list_slices(column, ("start", "n", "content", "digest"))
    start, n = start.astype(np.int64), n.astype(np.int64)
    of = np.repeat(np.arange(len(column)), np.diff(offsets))
    low, high = begin[of] + start, begin[of] + start + n - 1 + window
    stands = high <= end[of]
    claimed = np.array([x is not None for x in seen], bool)
    stands[claimed] = np.array([stands[k] and digest(int(low[k]), int(high[k])) == seen[k] for k in np.flatnonzero(claimed)], bool)
    found = np.flatnonzero(stands & ~claimed)
    if len(found):
        stands[found] = spans().of(low[found], high[found]) == content[found].astype(np.int64).view(np.uint64)
    return np.concatenate([[0], np.cumsum(np.bincount(of[stands], minlength=len(column)))]), start[stands], n[stands]


def asked_for(claimed: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id and spans, what is wanted of its text: the digest of each source, and runs to be taken apart."""
    digests = sources(claimed).select(F.lit(False).alias("taken_apart"), F.lit(0).cast("long").alias("anchor"), F.lit(0).cast("long").alias("crowd"), "doc", "start", "n")
    return by_document(digests.unionByName(asked.select(F.lit(True).alias("taken_apart"), "anchor", "crowd", "doc", "start", "n")), "taken_apart", "anchor", "crowd", "start", "n")


def with_digests(rows: pa.RecordBatch, doc: np.ndarray, start: np.ndarray, n: np.ndarray, digests: list[bytes]) -> pa.RecordBatch:
    """The rows, then those of digests, which have nothing in the other columns."""
    own = {"doc": pa.array(doc), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "digest": pa.array(digests, pa.binary())}
    columns = [pa.concat_arrays([rows.column(f.name), own.get(f.name, pa.nulls(len(doc), f.type))]) for f in rows.schema]
    columns.append(pa.concat_arrays([pa.nulls(rows.num_rows, pa.binary()), own["digest"]]))
    return pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "digest"])


def run_rows(docs: DataFrame, find: Callable[[np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """Runs of all documents with an id; find(bytes, ends) gives anchor, content, start, n and where each document's units start."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_bytes(part.column("text"))
        anchor, content, start, n, starts = find(data, at[1:])
        doc = np.searchsorted(starts, start, side="right") - 1
        return run_batch(anchor, content, part.column("doc_id").to_numpy()[doc], start - starts[doc], n)

    return map_slices(docs.where(F.col("doc_id").isNotNull()), work, RUN, limit=RUN_BYTES)
