"""Running a text function over whole tables, and joins against small tables of checked size."""

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

CHUNK = 512  # rows whose texts are Python objects at one time
CHUNK_BYTES = 4 << 20
ARROW_ROWS = 2_000  # whole texts that stand in one Arrow batch, on both sides
SMALL_BYTES = 32 << 20  # a side up to this size may be broadcast

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z, other bytes kept
#: Bytes of ``[0-9a-z]`` and of every code point from U+0080 stay, A-Z are lower-cased, all others part words.
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def lower_words(text: bytes | None) -> list:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z lower-cased; none for null."""
    return text.translate(LOWER).split() if text else []


def alnum_words(text: bytes | None) -> list:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased; none for null."""
    return text.translate(ALNUM).split() if text else []


def fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(name, _kind(kind)) for name, kind in kinds.items()])


def _kind(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_kind(text[6:-1]))
    return {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
            "boolean": T.BooleanType(), "binary": T.BinaryType()}[text]


def others(df: DataFrame, taken) -> list:
    """The frame's columns without those whose name, in any case, is among ``taken``."""
    taken = {name.lower() for name in taken}
    return [c for c in df.columns if c.lower() not in taken]


def extend(df: DataFrame, added: T.StructType, compute, text="text", keep=None, more=(), chunk=CHUNK) -> DataFrame:
    """Adds what ``compute`` finds for each row: it takes a list of UTF-8 texts (or None), and a list for each
    column of ``more``, and gives one list of values per added field.

    Rows pass in Arrow batches, which this lowers to ``ARROW_ROWS`` rows for the session, ``chunk`` texts at a time. ``keep``: the
    input columns to return, else all; a column named like an added one is replaced. A text that is kept goes along once.
    """
    keep = others(df.select(*[f"`{c}`" for c in (keep if keep is not None else df.columns)]), added.names)
    kinds = [df.schema[c].dataType for c in keep]
    given = [f"__k{i}" for i in range(len(keep))]  # names may hold dots, which functions over batches cannot take
    own = text in keep and isinstance(kinds[keep.index(text)], (T.StringType, T.BinaryType))
    at = keep.index(text) if own else len(keep)
    source = df.select(*[(F.col(f"`{c}`").cast("binary") if own and i == at else F.col(f"`{c}`")).alias(g)
                         for i, (c, g) in enumerate(zip(keep, given))],
                       *([] if own else [F.col(text).cast("binary").alias("__text")]),
                       *[F.col(c).alias(f"__{i}") for i, c in enumerate(more)])
    schema = T.StructType([*source.schema.fields[:len(keep)], *added.fields])
    limit_batches(df.sparkSession)

    def run(batches):
        forget_others(compute.__module__)
        try:
            for batch in batches:
                for part in chunks(batch, at, chunk):
                    columns = part.columns
                    values = compute(columns[at].to_pylist(), *[c.to_pylist() for c in columns[len(columns) - len(more):]])
                    arrays = [*columns[:len(keep)], *arrow_arrays(values, added)]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        finally:
            hand_back()

    return source.mapInArrow(run, schema).select(*[F.col(g).cast(k).alias(c) for c, g, k in zip(keep, given, kinds)],
                                                 *[f"`{c}`" for c in added.names])


_memories: dict = {}  # of a worker: what empties the memory of each operator


def remember(module: str, forget) -> None:
    """``forget`` empties what the module keeps in a worker from task to task."""
    _memories[module] = forget


def forget_others(module: str) -> None:
    """A worker that served other operators before keeps the memory of this one only."""
    for name, forget in _memories.items():
        if name != module:
            forget()


def hand_back() -> None:
    """Gives memory that a task has freed back to the system: workers serve many tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def limit_batches(spark) -> None:
    """Lowers Arrow batches to ``ARROW_ROWS`` rows for the session."""
    conf, rows = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= ARROW_ROWS:
        conf.set(rows, ARROW_ROWS)


def arrow_arrays(values, added: T.StructType) -> list:
    """One Arrow array for each of the added fields."""
    return [pa.array(v, _arrow(f.dataType)) for v, f in zip(values, added.fields)]


def chunks(batch, column: int, rows=CHUNK):
    """The batch in slices of at most ``rows`` rows and, beyond single long texts, ``CHUNK_BYTES`` of a text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for end, size in enumerate(sizes):
        if end > begin and (end - begin >= rows or held + size > CHUNK_BYTES):
            yield batch.slice(begin, end - begin)
            begin, held = end, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def _arrow(kind: T.DataType):
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
            "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


def join_small(df: DataFrame, small: DataFrame, on, how="inner", row_bytes=16) -> DataFrame:
    """Joins; ``small`` is broadcast if its counted rows times ``row_bytes`` stay under the bound, else shuffled."""
    if small.count() * row_bytes <= SMALL_BYTES:
        small = F.broadcast(small)
    return df.join(small, on, how)
