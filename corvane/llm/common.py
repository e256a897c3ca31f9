"""Small helpers shared by the text operators."""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space, and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task works on at a time.
SLICE = 2 << 20
#: Translation table that lower-cases A-Z and leaves every other byte.
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so that it is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-white-space characters; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def hash60(*parts: Column) -> Column:
    """First 60 bits of the MD5 of the parts joined by a colon, as a long.

    MD5 is in every SQL engine, so results can be checked outside Spark.  Null
    parts count as empty strings.
    """
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def unused(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, set up at first use.

    It is ``spark.checkpoint.dir``.  Only a local master, whose executors are the
    driver's own process, may do without: a temporary folder, removed at exit,
    takes its place.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import atexit
            import shutil
            import tempfile

            folder = tempfile.mkdtemp(prefix="corvane-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, as a Parquet table in the same folder: smaller for wide or long tables."""
    folder = f"{_checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches so that each part has about ``most_bytes`` of text.

    Yields the part and its texts as UTF-8 (null as empty).  A longer single
    text is a part of its own; no text is cut.
    """
    most_bytes = most_bytes or SLICE
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        start, held = 0, 0
        lengths = pa.compute.binary_length(texts).fill_null(0).to_pylist()
        for row, n in enumerate(lengths):
            if held and held + n > most_bytes:
                yield batch.slice(start, row - start), [t or b"" for t in texts.slice(start, row - start).to_pylist()]
                start, held = row, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start), [t or b"" for t in texts.slice(start).to_pylist()]


def picked(texts: list[str], most: int) -> Iterator[int]:
    """Indices of texts picked at random, the same for as many texts: one at least, then up to ``most`` characters."""
    held = 0
    for i in random.Random(len(texts)).sample(range(len(texts)), len(texts)):
        if held and held + len(texts[i]) > most:
            continue
        held += len(texts[i])
        yield i
        if held >= most:
            return
