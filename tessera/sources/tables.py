"""Readers, sinks and provenance of the tables."""

from __future__ import annotations

import hashlib
import io
import json
import lzma
import os
import shutil
import tempfile
import xml.sax.saxutils as sax
from collections.abc import Iterable
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.operators import validate as V

NODES = "class_id string, class_name string, package string, class_file_path string"
DEPENDENCIES = "source string, target string, dependency_type string, weight string, evidence_kind string, evidence_location string"
FLOWS = "source string, target string, flow_type string, weight string, evidence_method string, evidence_statement string"


def read_columns(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A CSV's required columns in schema order; other columns are ignored, missing ones are an error. Quotes in values are doubled.

    lines: values may hold line feeds; such a file can't be split between tasks."""
    want = [c.strip().split()[0] for c in schema.split(",")]
    df = spark.read.csv(path, header=True, escape='"', multiLine=lines)
    missing = [c for c in want if c not in df.columns]
    if missing:
        raise V.ValidationError(f"{path}: missing columns {', '.join(missing)}")
    return df.select(*want)


def _no_nulls(df: DataFrame, columns: Iterable[str], path: str) -> None:
    bad = [c for c, n in V.missing_values(df, list(columns)).first().asDict().items() if n]
    if bad:
        raise V.ValidationError(f"{path}: missing values in {', '.join(bad)}")


def class_nodes(spark: SparkSession, path: str) -> DataFrame:
    df = read_columns(spark, path, NODES)
    _no_nulls(df, ("class_id", "class_name"), path)
    return df


def _weighted(df: DataFrame, nodes: DataFrame, path: str, kind: str, allowed: Iterable[str]) -> DataFrame:
    _no_nulls(df, ("source", "target", kind, "weight"), path)
    faults = V.weight_faults(df).first()
    if faults["not_numeric"] or faults["negative"]:
        raise V.ValidationError(f"{path}: weights must be numeric and not negative")
    V.require(V.not_allowed(df, kind, list(allowed)), f"{path}: unknown {kind}")
    V.require(V.unknown_ends(df, nodes), f"{path}: unknown classes")
    return df.withColumn("weight", F.col("weight").cast("double"))


def structural_dependencies(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    df = read_columns(spark, path, DEPENDENCIES)
    V.require(V.not_allowed(df, "evidence_kind", list(V.KIND_TYPES)), f"{path}: unknown evidence_kind")
    V.require(V.kind_conflicts(df), f"{path}: evidence_kind and dependency_type differ")
    return _weighted(df, nodes, path, "dependency_type", ("type", "call"))


def flow_edges(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    return _weighted(read_columns(spark, path, FLOWS), nodes, path, "flow_type", V.FLOW_TYPES)


def extracted_subject(spark: SparkSession, folder: str, flows: bool = True) -> dict[str, DataFrame]:
    """The tables of a subject; without flows, that file is neither read nor needed."""
    nodes = class_nodes(spark, f"{folder}/class_nodes.csv")
    out = {"nodes": nodes, "dependencies": structural_dependencies(spark, f"{folder}/structural_dependencies.csv", nodes)}
    if flows:
        out["flows"] = flow_edges(spark, f"{folder}/ssa_flow_edges.csv", nodes)
    return out


def reference_mapping(spark: SparkSession, path: str) -> DataFrame:
    df = read_columns(spark, path, "class_name string, reference_service string").select(F.trim("class_name").alias("class_name"), F.trim("reference_service").alias("reference_service"))
    if not df.where("coalesce(class_name, '') = '' OR coalesce(reference_service, '') = ''").isEmpty():
        raise V.ValidationError(f"{path}: empty values")
    V.require(df.groupBy("class_name").count().where("count > 1").select("class_name"), f"{path}: repeated classes")
    return df


def semantic_edges(spark: SparkSession, path: str) -> DataFrame:
    """Three columns; the others are never parsed."""
    return spark.read.csv(path, header=True, escape='"').select("class_id_a", "class_id_b", F.col("weight").cast("double").alias("weight"))


def _input_file(path: str):
    """A random-access file of any file system that Arrow knows."""
    system, at = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    return system.open_input_file(at)


def embeddings(spark: SparkSession, path: str, rows: int, dimension: int, block: int = 1 << 16) -> DataFrame:
    """A .npy matrix of float32 (no pickles): row, embedding. The driver reads the header; tasks read blocks of rows."""
    with _input_file(path) as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        start = f.tell()
    if shape != (rows, dimension) or kind != np.dtype("<f4") or by_column:
        raise V.ValidationError(f"{path}: shape {shape} of {kind}")

    def run(batches):
        for t in batches:
            for k in t["id"]:
                count = min(block, rows - k * block)
                with _input_file(path) as f:
                    f.seek(start + 4 * dimension * k * block)
                    m = np.frombuffer(f.read(4 * dimension * count), "<f4").reshape(count, dimension)
                yield pd.DataFrame({"row": np.arange(k * block, k * block + count), "embedding": list(m)})

    blocks = -(-rows // block)
    return spark.range(0, blocks, 1, max(1, blocks)).mapInPandas(run, "row long, embedding array<float>")


def write_npy(vectors: DataFrame, path: str, order: str, rows: int, dimension: int) -> None:
    """embedding as a .npy matrix of float32 in order of a column, streamed through the driver."""
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (rows, dimension)})
        for r in vectors.orderBy(order).select("embedding").toLocalIterator():
            f.write(np.asarray(r[0], "<f4").tobytes())


def yaml_mapping(path: str) -> dict:
    import yaml

    out = yaml.safe_load(Path(path).read_text())
    if not isinstance(out, dict):
        raise V.ValidationError(f"{path}: not a mapping")
    return out


def extraction_arguments(config: dict, subject: str) -> list[str]:
    """Command line of an extractor for one subject: paths below project_root unless absolute, packages joined by commas, classpath by the path separator."""

    def text(key: str) -> str:
        value = config.get(key)
        if not isinstance(value, str) or not value.strip():
            raise V.ValidationError(f"{key} must be a text")
        return value.strip()

    def texts(key: str, needed: bool) -> list[str]:
        value = config.get(key) or []
        if not isinstance(value, list) or not all(isinstance(x, str) and x.strip() for x in value) or (needed and not value):
            raise V.ValidationError(f"{key} must be a list of texts")
        return [x.strip() for x in value]

    if text("subject") != subject:
        raise V.ValidationError(f"the configuration of {config['subject']} isn't that of {subject}")
    root = Path(text("project_root"))
    options = {
        "--subject": subject,
        "--classes-dir": str(root / text("classes_dir")),
        "--classpath": os.pathsep.join(str(root / x) for x in texts("classpath_entries", True)),
        "--app-packages": ",".join(texts("app_packages", True)),
        "--exclude-packages": ",".join(texts("exclude_packages", False)),
        "--out-dir": text("extracted_output_path"),
    }
    return [part for option, value in options.items() if value for part in (option, value)]


def xz_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """xz-compressed CSVs, read by Spark from any file system; Spark has no codec for xz, so each file is one task's bytes (under 2 GB packed)."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for t in batches:
            for content in t["content"]:
                with lzma.open(io.BytesIO(content), "rt") as f:
                    for part in pd.read_csv(f, usecols=columns, dtype=str, chunksize=50_000):
                        yield part[columns]

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{c} string" for c in columns))
    return raw.selectExpr(*(f"CAST({c.strip().split()[0]} AS {c.strip().split()[1]}) AS {c.strip().split()[0]}" for c in schema.split(",")))


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: Iterable[str] = ()) -> None:
    w = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    w.csv(path, header=True, escape='"') if kind == "csv" else w.option("compression", "zstd").parquet(path)


def write_xz_csv(df: DataFrame, path: str) -> None:
    """One xz file, streamed through the driver."""
    with lzma.open(path, "wt", preset=6) as f:
        f.write(",".join(df.columns) + "\n")
        for r in df.toLocalIterator():
            pd.DataFrame([tuple(r)]).to_csv(f, header=False, index=False)


#: Characters that an attribute can't hold as they are.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, weight: str) -> None:
    """GraphML in a stable order. Tasks write the lines; the driver only appends their files, some bytes at a time, to the one at path."""
    quoted = lambda c: F.concat(F.lit('"'), reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), _ESCAPES, F.col(c)), F.lit('"'))
    node = F.concat(F.lit("<node id="), quoted("class_id"), F.lit("/>"))
    edge = F.concat(F.lit("<edge source="), quoted("source"), F.lit(" target="), quoted("target"), F.lit('><data key="w">'), F.col(weight).cast("double").cast("string"), F.lit("</data></edge>"))
    with open(path, "wb") as f:
        f.write(b'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        f.write(f'<key id="w" for="edge" attr.name={sax.quoteattr(weight)} attr.type="double"/>\n<graph edgedefault="undirected">\n'.encode())
        for rows, order, line in ((nodes, ["class_id"], node), (edges, ["source", "target"], edge)):
            parts = Path(f"{path}.{order[0]}")
            rows.orderBy(*order).select(line.alias("value")).write.text(parts.absolute().as_uri())
            for part in sorted(parts.glob("part-*")):
                with part.open("rb") as lines:
                    shutil.copyfileobj(lines, f)
            shutil.rmtree(parts)
        f.write(b"</graph>\n</graphml>\n")


def read_graphml(spark: SparkSession, path: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, read by tasks: Spark cuts the file at the elements. An edge's first data element is its weight."""
    rows = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).options(mode="FAILFAST", ignoreSurroundingSpaces="false", nullValue="\0").schema(schema).load(Path(path).absolute().as_uri())
    edges = rows("edge", "_source string, _target string, data array<struct<_VALUE: double, _key: string>>")
    return rows("node", "_id string").select(F.col("_id").alias("class_id")), edges.select(F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("data")[0]["_VALUE"].alias(weight))


def lossless(value: float, digits: int = 17) -> str:
    return format(value, f".{digits}g")


def lossless_text(digits: int = 17):
    """lossless as a function of a double column."""

    @F.pandas_udf(StringType())
    def run(value: pd.Series) -> pd.Series:
        return value.map(lambda x: None if pd.isna(x) else lossless(x, digits))

    return run


def markdown_table(df: DataFrame) -> str:
    """A report table; for results that are reports already."""
    head = [f"| {' | '.join(df.columns)} |", f"|{'|'.join('---' for _ in df.columns)}|"]
    return "\n".join([*head, *(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in df.toLocalIterator())]) + "\n"


def replace_block(text: str, name: str, block: str) -> str:
    begin, end = f"<!-- BEGIN {name} -->", f"<!-- END {name} -->"
    if begin not in text or end not in text:
        raise V.ValidationError(f"no block {name}")
    return text[: text.index(begin) + len(begin)] + "\n" + block.strip() + "\n" + text[text.index(end) :]


def write_or_check(path: str, data: bytes, check: bool = False) -> None:
    """Write, or fail when the file there differs."""
    p = Path(path)
    if check:
        if not p.exists() or p.read_bytes() != data:
            raise V.ValidationError(f"{path} is stale")
    else:
        p.write_bytes(data)


def atomic_json(path: str, value) -> None:
    fd, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.replace(name, path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and bytes of files, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def contract_digest(fields: dict, required: Iterable[str]) -> str:
    """SHA-256 of the sorted compact JSON; all required fields must be there."""
    missing = sorted(set(required) - set(fields))
    if missing:
        raise V.ValidationError(f"missing fields: {', '.join(missing)}")
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def same_manifest(a: dict, b: dict, ignore: Iterable[str] = ("branch", "head")) -> bool:
    drop = lambda d: {k: drop(v) if isinstance(v, dict) else v for k, v in d.items() if k not in ignore}
    return drop(a) == drop(b)


def dot_graph(edges: Iterable[tuple], labels: dict[str, str]) -> str:
    """Graphviz text with stable order and quoting."""
    q = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    body = [f"  {q(k)} [label={q(v)}];" for k, v in sorted(labels.items())]
    body += [f"  {q(a)} -- {q(b)} [weight={w:g}];" for a, b, w in sorted(edges)]
    return "graph g {\n" + "\n".join(body) + "\n}\n"
