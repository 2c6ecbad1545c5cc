"""A cluster index kept on disk: written once, opened by other sessions.

A save writes its tables into a folder of its own and a manifest last. The manifest names the
folder, so an index is there as a whole or not at all, and a save that broke off is never seen.
Older saves stay readable until they are deleted.
"""

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kinlink.operators.clustering import Scaler
from kinlink.plans.index import ClusterIndex
from kinlink.sources.tables import read_centroids, read_index, write_centroids, write_index

FORMAT = 1
_SCALER = "pos int, mean double, std double"


class IncompleteIndex(ValueError):
    """There is no whole index that this version can read."""


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and name of every manifest, the newest last."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    found = [n for n in names if n.startswith("manifest-") and n.endswith(".json")]
    return sorted((int(n[len("manifest-") : -len(".json")]), n) for n in found)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and rename it; refuse to replace one."""
    files, where = _files(spark, path)
    _, draft = _files(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(where) or not files.rename(draft, where):
        files.delete(draft, False)
        raise IncompleteIndex(f"another save has written {path}")


def save_index(index: ClusterIndex, path: str) -> int:
    """Write ``index`` below ``path`` and return the number of the save.

    Records go into one folder for each cluster, so that opening reads only clusters in use.
    """
    spark = index.records.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    write_index(index.records, f"{path}/{folder}/records")
    write_centroids(index.centroids, f"{path}/{folder}/centroids")
    cells = [(i, float(m), float(s)) for i, (m, s) in enumerate(zip(index.scaler.mean, index.scaler.std))]
    spark.createDataFrame(cells, _SCALER).write.parquet(f"{path}/{folder}/scaler")
    written = read_index(spark, f"{path}/{folder}/records")
    manifest = {
        "format": FORMAT,
        "folder": folder,
        "records": written.count(),
        "centroids": index.centroids.count(),
        "width": len(cells),
        "schema": json.loads(index.records.schema.json()),
    }
    number = max([n for n, _ in _manifests(spark, path)], default=0) + 1
    _write_text(spark, f"{path}/manifest-{number}.json", json.dumps(manifest))
    return number


def open_index(spark: SparkSession, path: str, number: int | None = None) -> ClusterIndex:
    """The newest whole index below ``path``, or the save with that number.

    Raises ``IncompleteIndex`` if there is no manifest, if it is of another format, or if one of
    the tables it names is missing or not complete.
    """
    found = [(n, name) for n, name in _manifests(spark, path) if number in (None, n)]
    if not found:
        raise IncompleteIndex(f"no index below {path}")
    text = spark.read.text(f"{path}/{found[-1][1]}", wholetext=True).first()[0]
    try:
        manifest = json.loads(text)
    except json.JSONDecodeError as error:
        raise IncompleteIndex(f"the manifest {found[-1][1]} is damaged") from error
    if manifest.get("format") != FORMAT:
        raise IncompleteIndex(f"format {manifest.get('format')}, not {FORMAT}")
    folder = f"{path}/{manifest['folder']}"
    for name in ("records", "centroids", "scaler"):
        files, done = _files(spark, f"{folder}/{name}/_SUCCESS")
        if not files.exists(done):
            raise IncompleteIndex(f"the table {name} below {path} is not complete")
    schema = T.StructType.fromJson(manifest["schema"])
    records: DataFrame = spark.read.schema(schema).parquet(f"{folder}/records")
    centroids = read_centroids(spark, f"{folder}/centroids")
    cells = spark.read.schema(_SCALER).parquet(f"{folder}/scaler").orderBy("pos").collect()
    # Row counts come from the footers of the files.
    for name, rows, most in (("records", records.count(), manifest["records"]), ("centroids", centroids.count(), manifest["centroids"]), ("scaler", len(cells), manifest["width"])):
        if rows != most:
            raise IncompleteIndex(f"{rows} rows of {most} in the table {name} below {path}")
    scaler = Scaler(np.array([c["mean"] for c in cells]), np.array([c["std"] for c in cells]))
    return ClusterIndex(records.select(*schema.names), centroids, scaler)
