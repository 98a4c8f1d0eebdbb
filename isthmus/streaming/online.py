"""Online indices with Structured Streaming.

learn_stream keeps the map of each stream key as state in parts: categories in pages of PAGE, and the counters of each
class as a row of its own. A micro-batch reads a key's parts and writes back the pages whose categories it has made or
moved and the rows of the classes it has met. Samples of a micro-batch are taken in the order of ord, keys run in
parallel, and a row with the current indices leaves for each key and micro-batch. refit_stream recomputes an offline
index for each micro-batch. State and offsets live in the checkpoint folder, so that a restart goes on where it stood.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from isthmus.operators.art import ArtLearner

#: warning: what the learner had to say in this micro-batch, null if nothing.
OUTPUT = "stream_id string, last_ord long, samples long, categories int, index double, weighted_index double, warning string"
#: Categories in a page of state.
PAGE = 32
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"


#: Samples of a key on their way to it: many a row, as plain numbers.
PACK = "stream_id string, ord binary, width int, features binary, labels binary, names array<string>"
#: Place of a sample without ord: behind all others.
_LAST = np.iinfo(np.int64).max


def _packs(batches: Iterator) -> Iterator:
    """Samples (stream_id, ord, features, label) as packs, one for each key and Arrow batch: so many rows fewer to deal out."""
    import pyarrow as pa

    kind = pa.schema([("stream_id", pa.string()), ("ord", pa.binary()), ("width", pa.int32()), ("features", pa.binary()), ("labels", pa.binary()), ("names", pa.list_(pa.string()))])
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, labels = (batch.column(i).dictionary_encode() for i in (0, 3))
        of, label = (c.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32) for c in (keys, labels))
        place = batch.column(1).fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, flat = batch.column(2).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
        if (sizes < 0).any():
            raise ValueError("a sample must be 1D and finite")
        starts = np.cumsum(sizes) - sizes
        key_names, names = [*keys.dictionary.to_pylist(), None], [*labels.dictionary.to_pylist(), None]
        order = np.argsort(of, kind="stable")
        out: list[list] = [[] for _ in kind]
        for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            width = int(sizes[rows[0]])
            if (sizes[rows] != width).any():
                raise ValueError("samples must have equally many features")
            met, codes = np.unique(label[rows], return_inverse=True)
            pack = (key_names[of[rows[0]]], place[rows].tobytes(), width, flat[starts[rows][:, None] + np.arange(width)].tobytes(), codes.astype(np.int32).tobytes(), [str(names[i]) for i in met.tolist()])
            for column, v in zip(out, pack, strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kind.types, strict=True)], schema=kind)


def _unpacked(tables: Iterator) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """ord, features and labels of a key's samples in the order of ord."""
    number: dict[str, int] = {}
    places, xs, ys, widths = [], [], [], set()
    for t in tables:
        for place, width, x, codes, names in zip(t["ord"], t["width"], t["features"], t["labels"], t["names"], strict=True):
            places.append(np.frombuffer(place, dtype=np.int64))
            xs.append(np.frombuffer(x).reshape(len(places[-1]), int(width)))
            ys.append(np.array([number.setdefault(y, len(number)) for y in names], dtype=np.int32)[np.frombuffer(codes, dtype=np.int32)])
            widths.add(int(width))
    if len(widths) > 1:
        raise ValueError("samples must have equally many features")
    place = np.concatenate(places)
    order, names = np.argsort(place, kind="stable"), list(number)
    return place[order], np.concatenate(xs)[order], [names[i] for i in np.concatenate(ys)[order].tolist()]


class Keeper(StatefulProcessor):
    """One key's learner, kept as pages of categories and rows of counters."""

    def __init__(self, mode: str, params: dict, page: int = PAGE):
        self.mode, self.params, self.page = mode, params, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("categories", "page long", "w binary, radius binary, owners array<string>")
        self.classes = handle.getMapState("classes", "label string", "support long, singleton double, others array<string>, adj array<long>, pairwise array<double>")

    def _read(self) -> ArtLearner:
        m = ArtLearner(**self.params)
        pages = sorted((page, *value) for (page,), value in self.pages.iterator())
        if pages:
            radius = np.frombuffer(b"".join(bytes(p[2]) for p in pages))
            w = np.frombuffer(b"".join(bytes(p[1]) for p in pages)).reshape(len(radius), -1)
            m.put_categories(w.copy(), radius.copy(), [y for p in pages for y in p[3]])
        for (y,), (support, single, others, adj, index) in self.classes.iterator():
            m.support[y], m.singleton[y] = support, single
            for b, n, v in zip(others, adj, index, strict=True):
                m.adj[y, b], m.pairwise[y, b] = int(n), float(v)
        return m

    def _write(self, m: ArtLearner, met: set[str]) -> None:
        owners = m.owner
        for page in sorted({j // self.page for j in m.moved}):
            mine = slice(page * self.page, (page + 1) * self.page)
            self.pages.updateValue((page,), (m.w[mine].tobytes(), m.radius[mine].tobytes(), owners[mine]))
        rows: dict[str, list] = {y: [] for y in met}
        for (y, b), n in m.adj.items():
            if y in rows:
                rows[y].append((b, n, m.pairwise[y, b]))
        for y, found in rows.items():
            others, adj, index = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
            self.classes.updateValue((y,), (m.support[y], m.singleton[y], others, adj, index))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        m = self._read()
        places, xs, ys = _unpacked(rows)
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            if self.mode == "batch":
                m.add_batch(xs, ys)
            else:
                m.add_samples(xs, ys)
        self._write(m, set(ys))
        texts = list(dict.fromkeys(str(w.message) for w in said))
        yield pd.DataFrame({
            "stream_id": [key[0]], "last_ord": [int(places[places < _LAST][-1])], "samples": [sum(m.support.values())], "categories": [m.n],
            "index": [m.index()], "weighted_index": [m.weighted_index()], "warning": pd.Series(["; ".join(texts) or None], dtype=object),
        })


def learn_stream(samples: DataFrame, mode: str = "batch", **params) -> DataFrame:
    """A streaming DataFrame of OUTPUT from streaming samples (stream_id, ord, features, label). mode: batch replays each micro-batch after training on it, sample learns and counts row by row. State in parts needs the RocksDB state store, which this names to the session unless the session names one itself."""
    if mode not in ("batch", "sample"):
        raise ValueError("mode must be 'batch' or 'sample'")
    spark = samples.sparkSession
    if "HDFSBacked" in spark.conf.get(PROVIDER, "HDFSBacked"):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = samples.select(F.col("stream_id").cast("string"), F.col("ord").cast("long"), F.col("features").cast("array<double>"), F.col("label").cast("string").alias("label"))
    return rows.mapInArrow(_packs, PACK).groupBy("stream_id").transformWithStateInPandas(Keeper(mode, params, PAGE), OUTPUT, "append", "none")


def _ended(query: StreamingQuery, timeout: float | None) -> None:
    """Waits for the end of a stream, however long it takes; timeout: no longer than so many seconds."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout} s")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, timeout: float | None = None, keys: int | None = None) -> DataFrame:
    """Writes all that is available of a stream to a Parquet folder and reads it. timeout: seconds after which it is given up (None: never). keys: how many keys the stream has, if that is known; then its state has no more partitions than keys: each is opened and committed in every micro-batch, filled or not."""
    conf = stream.sparkSession.conf
    held = conf.get(PARTITIONS)
    try:
        if keys:
            conf.set(PARTITIONS, str(keys))
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(PARTITIONS, held)  # the query keeps what it was started with
    _ended(query, timeout)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def refit_stream(samples: DataFrame, fit: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, timeout: float | None = None) -> DataFrame:
    """fit(batch) -> one-row summary for every micro-batch; a batch that is run again overwrites its own folder."""
    spark = samples.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        fit(batch).withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/n={number}")

    query = samples.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    _ended(query, timeout)
    return spark.read.option("basePath", path).parquet(f"{path}/n=*").drop("n")
