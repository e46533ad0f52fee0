"""Recordings from array archives: NPZ and level-5 MATLAB files natively, HDF5 files where its library is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matlab import arrays, variables

SCHEMA = "recording string, sensor string, samples array<double>, sha256 string"


def _rows(path: str, values):
    """One row per one-dimensional array; columns of a matrix are numbered sensors."""
    import hashlib

    import numpy as np

    recording = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for name, value in values:
        value = np.asarray(value, "<f8")
        for sensor, x in [(name, value)] if value.ndim == 1 else [(f"{name}_{i}", value[:, i]) for i in range(value.shape[1])]:
            yield recording, sensor, np.ascontiguousarray(x), hashlib.sha256(np.ascontiguousarray(x).tobytes()).hexdigest()


def _read(spark: SparkSession, path: str, opened) -> DataFrame:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                for row in _rows(file, opened(content)):
                    yield pd.DataFrame([row], columns=["recording", "sensor", "samples", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``recording, sensor, samples, sha256`` of every array; the digest is that of the samples as little-endian doubles."""

    def opened(content):
        import io

        import numpy as np

        with np.load(io.BytesIO(content)) as z:
            return [(n, z[n]) for n in z.files]

    return _read(spark, path, opened)


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """The real arrays of one or two dimensions of level-5 MATLAB files; a field of a structure is named ``structure.field``."""

    def opened(content):
        squeezed = ((n, v.squeeze()) for n, v in arrays(content) if v.dtype.kind in "fiu")
        return [(n, v) for n, v in squeezed if v.ndim in (1, 2)]

    return _read(spark, path, opened)


TRACKED = "file string, hour bigint, sdn double, frequencies array<double>, environment map<string,double>"


def read_tracked_modes(spark: SparkSession, path: str, structure: str = "modes") -> DataFrame:
    """``file, hour, sdn, frequencies, environment``: a row for each hour of the structure's fields ``sdn``, ``f`` and ``env``, whose columns ``labels_env`` names.

    Values that aren't finite are null. A file is read by one task.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        clean = lambda row: [float(x) if np.isfinite(x) else None for x in row]
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                found = dict(variables(content)).get(structure)
                if not isinstance(found, dict) or not {"sdn", "f", "env", "labels_env"} <= found.keys():
                    raise ValueError(f"{file} has no structure {structure} with sdn, f, env and labels_env")
                times, n = np.ravel(found["sdn"]), np.size(found["sdn"])
                f, env, labels = found["f"].reshape(n, -1), found["env"].reshape(n, -1), [str(x) for x in found["labels_env"]]
                if len(labels) != env.shape[1]:
                    raise ValueError(f"{file} names {len(labels)} of {env.shape[1]} environment channels")
                for at in range(0, n, 4096):
                    part = range(at, min(n, at + 4096))
                    yield pd.DataFrame(
                        {"file": file, "hour": list(part), "sdn": times[at : part.stop], "frequencies": [clean(f[i]) for i in part], "environment": [dict(zip(labels, clean(env[i]))) for i in part]}
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TRACKED)


def read_hdf5(spark: SparkSession, path: str, datasets: list[str]) -> DataFrame:
    """The named datasets of HDF5 files; takes h5py on the executors."""
    names = list(datasets)

    def opened(content):
        import io

        import h5py

        with h5py.File(io.BytesIO(content)) as f:
            return [(n.replace("/", "_"), f[n][()]) for n in names]

    return _read(spark, path, opened)


def attributes(pairs: DataFrame) -> DataFrame:
    """``recording, attributes map<string,string>`` from ``recording, name, value`` rows."""
    return pairs.groupBy("recording").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("value").cast("string").alias("value"))))).alias("attributes"))
