"""The engine as one object: datasets in; SQL, plans, questions and profiles out."""

from __future__ import annotations

import json
import logging
import re
import threading
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import cache, nl, research
from siltstone.catalog import DEFAULT_WORKSPACE, Catalog, Dataset, Manifest, Snapshot
from siltstone.corpora import Corpora
from siltstone.errors import BadFile, EngineError, UnsupportedSql
from siltstone.functions.stats import file_stats, footer_stats
from siltstone.history import History
from siltstone.operators import profile
from siltstone.operators.text import Embedder, HashEmbedder
from siltstone.plans import ir, lower, pruning, sqlfront
from siltstone.sources import csv, external, mixed
from siltstone.telemetry import METRICS

log = logging.getLogger(__name__)

#: Settings that the plan language's meaning relies on.
CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true"}
#: Rows of a profile's sample.
SAMPLE = 10_000
_lock = threading.Lock()


@dataclass
class Result:
    """rows as an Arrow table. plan: None where SQL went beyond the plan language."""

    table: pa.Table
    plan: ir.Plan | None = None
    cache_hit: bool = False
    narration: str | None = None

    def to_pandas(self):  # noqa: ANN201
        return self.table.to_pandas()

    def rows(self) -> list[dict]:
        return self.table.to_pylist()

    def to_ipc(self) -> bytes:
        """An Arrow stream."""
        return to_ipc(self.table)

    def json_rows(self) -> list[dict]:
        """Rows for JSON readers that hold numbers as doubles: whole numbers beyond 2 ** 53 as text."""

        def one(x: object) -> object:
            if isinstance(x, int) and not isinstance(x, bool) and abs(x) > (1 << 53) - 1:
                return str(x)
            return x.isoformat() if hasattr(x, "isoformat") else x

        return [{k: one(v) for k, v in r.items()} for r in self.rows()]


def to_ipc(table: pa.Table | None) -> bytes:
    """No table is no bytes."""
    if table is None:
        return b""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table | None:
    return pa.ipc.open_stream(data).read_all() if data else None


@dataclass(frozen=True)
class Explained:
    plan: dict | None
    optimized: dict | None
    tree: str
    files_before: int
    files_after: int
    cache_hit: bool
    physical: str = ""


@dataclass
class Session:
    spark: SparkSession
    root: str
    workspace: str = DEFAULT_WORKSPACE
    user: str = ""
    provider: nl.Provider | None = None
    embedder: Embedder = field(default_factory=HashEmbedder)
    results: cache.ResultCache = field(default_factory=cache.ResultCache)
    #: Tables of this session alone, by name; they hide datasets of the same name.
    inline: dict[str, pa.Table] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k, v in CONF.items():
            self.spark.conf.set(k, v)
        self.catalog = Catalog(self.spark, f"{self.root.rstrip('/')}/catalog")
        self.past = History(self.spark, self.root)
        self.corpora = Corpora(self.spark, self.root, self.embedder)

    # --- data in ---

    def ingest(self, name: str, df: DataFrame, operation: str = "append", partition_by: list[str] | None = None, compression: str = "zstd", distinct: bool = True) -> Snapshot:
        """Rows as Parquet files of the dataset, with statistics for skipping files. Without `distinct` they come from the files' footers, and the
        written rows aren't read again to count distinct values."""
        dataset = self.catalog.ensure(name, df.schema, self.workspace)
        if [f.name for f in dataset.schema] != df.columns:
            raise EngineError(f"{name!r} has the columns {', '.join(dataset.columns)}")
        folder = self.catalog.data_folder(dataset)
        out = df.write.option("compression", compression)
        (out.partitionBy(*partition_by) if partition_by else out).parquet(folder)
        return self._committed(dataset, folder, operation, partition_by or [], distinct)

    def _committed(self, dataset: Dataset, folder: str, operation: str, partition_by: list[str], distinct: bool) -> Snapshot:
        return self.catalog.commit(dataset, self._manifests(dataset, folder, partition_by, distinct), operation)

    def _manifests(self, dataset: Dataset, folder: str, partition_by: list[str], distinct: bool = True) -> list[Manifest]:
        sizes = {_plain(p): n for p, n in self.catalog.files.data_files(folder)}
        found = {} if distinct or not sizes else footer_stats(self.spark, sorted(sizes))
        if sizes and len(found) < len(sizes):
            found = file_stats(self.spark.read.parquet(folder), [c for c in dataset.columns if c not in partition_by])
        stats = {_plain(p): s for p, s in found.items()}
        kinds = {f.name: f.dataType for f in dataset.schema}
        manifests = []
        for path, size in sorted(sizes.items()):
            own = stats.get(path, {"rows": 0, "stats": {}})
            manifests.append(Manifest(path, "parquet", {c: _hive_value(path, c, kinds[c]) for c in partition_by}, own["rows"], size, own["stats"]))
        return manifests

    # --- changes: files that can't hold a changed row stay as they are, the others are written anew; of two changes at once one fails ---

    def _changed(self, name: str, condition: str | None, change) -> Snapshot:  # noqa: ANN001
        """change: of a frame of the files that may hold rows with the condition (SQL; None: all), to what they shall hold."""
        dataset = self.catalog.get(name, self.workspace)
        base = self.catalog.current(dataset)
        files, predicates = self.catalog.manifests(base), []
        if condition is not None:
            parsed = self.parse(name, f"SELECT * FROM `{name}` WHERE {condition}")
            predicates = [p for own in ir.scan_predicates(parsed.plan).values() for p in own] if parsed.plan is not None else []
        touched = pruning.prune(files, predicates)
        folder = self.catalog.data_folder(dataset)
        out = change(mixed.read(self.spark, dataset.schema, touched))
        out.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in dataset.schema)).write.option("compression", "zstd").parquet(folder)
        paths = {m.path for m in touched}
        return self.catalog.commit(dataset, [*(m for m in files if m.path not in paths), *self._manifests(dataset, folder, [])], "overwrite", base=base)

    def delete(self, name: str, condition: str) -> Snapshot:
        """Without the rows for which the condition is true; those for which it is null stay."""
        return self._changed(name, condition, lambda df: df.where(~F.coalesce(F.expr(condition), F.lit(False))))

    def update(self, name: str, values: dict[str, str], condition: str = "true") -> Snapshot:
        """Columns set to SQL expressions of the old row, where the condition is true."""
        unknown = set(values) - set(self._columns(name))
        if unknown:
            raise EngineError(f"{name!r} has no column {min(unknown)!r}")
        hit = F.coalesce(F.expr(condition), F.lit(False))
        return self._changed(name, condition, lambda df: df.select(*((F.when(hit, F.expr(values[c])).otherwise(F.col(f"`{c}`")) if c in values else F.col(f"`{c}`")).alias(c) for c in df.columns)))

    def merge(self, name: str, source: DataFrame, on: list[str], matched: str = "update", insert: bool = True) -> Snapshot:
        """Rows whose keys the source has become the source's (matched: update), go (delete) or stay (keep); the source's others are added. Null keys match nothing.
        Keys must be distinct in the source."""
        if matched not in ("update", "delete", "keep"):
            raise EngineError(f"unknown action {matched!r}")
        columns, keyed = self._columns(name), source.dropna(subset=on)
        if source.columns != columns:
            raise EngineError(f"{name!r} has the columns {', '.join(columns)}")
        if not keyed.groupBy(*on).count().where("count > 1").isEmpty():
            raise EngineError("the source has several rows with the same keys")
        rows = [F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_new"), *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(on))]

        def change(df: DataFrame) -> DataFrame:
            same = [F.col(f"`{k}`") == F.col(f"_k{i}") for i, k in enumerate(on)]
            found = keyed.select(*rows)
            out = df if matched == "keep" else df.join(found.drop("_new"), same, "left_anti")
            if matched == "update":
                out = out.unionByName(df.select(*(F.col(f"`{k}`") for k in on)).distinct().join(found, same).select("_new.*"))
            more = source.join(df.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(on))), same, "left_anti")
            return out.unionByName(more) if insert else out

        return self._changed(name, None, change)

    def ingest_csv(self, name: str, path: str, operation: str = "append", partition_by: list[str] | None = None) -> Snapshot:
        """The dataset's schema is that of the first file; later ones must fit it."""
        try:
            schema = self.catalog.get(name, self.workspace).schema
        except EngineError:
            schema = csv.infer_file(self.spark, path)
        return self.ingest(name, csv.read(self.spark, path, schema), operation, partition_by)

    def register_files(self, name: str, paths: list[str], format: str, schema: T.StructType | None = None, operation: str = "append") -> Snapshot:
        """Files where they are, of one format of many."""
        if schema is None:
            schema = csv.infer_file(self.spark, paths) if format == "csv" else self.spark.read.format(format).load(paths).schema
        dataset = self.catalog.ensure(name, schema, self.workspace)
        found = footer_stats(self.spark, paths) if format == "parquet" else {}
        for p, own in found.items():
            if missing := [c for c in dataset.columns if c not in own["columns"]]:
                raise BadFile(f"{p} lacks the column {missing[0]!r}")
        unread = [p for p in paths if p not in found] if format in ("parquet", "orc") else []
        found |= file_stats(self.spark.read.format(format).load(unread)) if unread else {}
        stats = {_plain(p): s for p, s in found.items()}
        manifests = [Manifest(p, format, {}, stats.get(_plain(p), {}).get("rows"), self.catalog.files.size(p), stats.get(_plain(p), {}).get("stats", {})) for p in paths]
        return self.catalog.commit(dataset, manifests, operation)

    def _register(self, name: str, table: external.ExternalTable, operation: str) -> Snapshot:
        if not table.files:
            raise BadFile("the table has no live files")
        return self.catalog.commit(self.catalog.ensure(name, table.schema, self.workspace), table.files, operation)

    def register_iceberg(self, name: str, metadata_json: str, operation: str = "overwrite") -> Snapshot:
        """The table's files, where they are; a later call follows the table's later state."""
        return self._register(name, external.iceberg(self.spark, metadata_json), operation)

    def register_delta(self, name: str, table: str, operation: str = "overwrite") -> Snapshot:
        return self._register(name, external.delta(self.spark, table), operation)

    def register_arrow(self, name: str, table: pa.Table | bytes) -> None:
        """Batches that are there already, as a table or an Arrow stream: plans and SQL of this session read them like a dataset."""
        self.inline[name] = from_ipc(table) if isinstance(table, bytes) else table

    def register_function(self, name: str, function, returns: str | T.DataType, kind: str = "scalar") -> None:  # noqa: ANN001
        """For this session's SQL. scalar and aggregate: of pandas series, in Arrow batches (an aggregate's group is in memory at once); table: a class whose eval() yields rows."""
        if kind == "table":
            self.spark.udtf.register(name, F.udtf(function, returnType=returns))
        elif kind in ("scalar", "aggregate"):
            self.spark.udf.register(name, F.pandas_udf(function, returns, F.PandasUDFType.SCALAR if kind == "scalar" else F.PandasUDFType.GROUPED_AGG))
        else:
            raise EngineError(f"unknown kind of function {kind!r}")

    def create_dataset(self, name: str, schema: T.StructType) -> Dataset:
        return self.catalog.create(name, schema, self.workspace)

    def datasets(self) -> list[Dataset]:
        return self.catalog.datasets(self.workspace)

    def ingest_corpus(self, corpus: str, docs: DataFrame | str, id_col: str = "doc_id", text_col: str = "text") -> int:
        return self.corpora.ingest(corpus, mixed.text_files(self.spark, docs) if isinstance(docs, str) else docs, id_col, text_col)

    # --- queries ---

    def frame(self, name: str, snapshot_id: str = "", predicates: list[ir.Expr] | None = None) -> DataFrame:
        """A dataset's rows, from the files that the predicates leave possible."""
        if name in self.inline:
            return self.spark.createDataFrame(self.inline[name])
        dataset = self.catalog.get(name, self.workspace)
        files = self.catalog.manifests(self.catalog.snapshot(dataset, snapshot_id))
        return mixed.read(self.spark, dataset.schema, pruning.prune(files, predicates or []))

    def lowered(self, plan: ir.Plan) -> DataFrame:
        """A plan's DataFrame, not yet run."""
        by = ir.scan_predicates(plan)
        return lower.lower(plan, lambda s: self.frame(s.dataset, s.snapshot_id, by.get(s, [])))

    def _schemas(self, plan: ir.Plan) -> dict[str, list[str]]:
        return {s.dataset: self._columns(s.dataset) for s in ir.scans(plan)}

    def _columns(self, name: str) -> list[str]:
        return self.inline[name].column_names if name in self.inline else self.catalog.get(name, self.workspace).columns

    def _snapshot_key(self, plan: ir.Plan) -> str:
        out = []
        for s in sorted(set(ir.scans(plan)), key=lambda s: (s.dataset, s.snapshot_id)):
            if s.dataset in self.inline:
                out.append(f"{s.dataset}@{id(self.inline[s.dataset])}")
                continue
            found = self.catalog.snapshot(self.catalog.get(s.dataset, self.workspace), s.snapshot_id)
            out.append(f"{self.workspace}/{s.dataset}@{found.id if found else ''}")
        return ",".join(out)

    def parse(self, dataset: str, sql: str) -> sqlfront.Parsed:
        return sqlfront.parse(self.spark, sql, dataset, self._columns(dataset))

    def _direct(self, dataset: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
        """SQL beyond the plan language, as Spark runs it. It may read all datasets of the workspace by name."""
        names = {d.name for d in self.datasets()} | set(self.inline)
        with _lock:
            for t in {dataset, *tables}:
                if t in names:
                    self.frame(t).createOrReplaceTempView(f"`{t}`")
            self.frame(dataset).createOrReplaceTempView("t")
            return self.spark.sql(sql)

    def query(self, dataset: str, sql: str) -> Result:
        k = self.past.start("sql", sql, dataset, self.workspace, self.user)
        return self._recorded(k, lambda: self._run_sql(k, dataset, sql))

    def query_plan(self, plan: ir.Plan | str) -> Result:
        plan = ir.from_json(plan) if isinstance(plan, str) else plan
        k = self.past.start("plan", ir.to_json(plan), next(ir.scans(plan)).dataset, self.workspace, self.user)
        return self._recorded(k, lambda: self._run(k, plan))

    def query_nl(self, dataset: str, question: str, narrate: bool = False) -> Result:
        k = self.past.start("nl", question, dataset, self.workspace, self.user)

        def run() -> Result:
            plan, _ = nl.to_plan(question, dataset, self._types(dataset), self._model())
            result = self._run(k, plan)
            if narrate:
                try:
                    result.narration = nl.narrate_rows(question, result.rows()[:100], self._model())
                except Exception:
                    log.exception("narration failed")
            return result

        return self._recorded(k, run)

    def _model(self) -> nl.Provider:
        if self.provider is None:
            raise EngineError("this session has no language provider")
        return self.provider

    def _types(self, dataset: str) -> dict[str, str]:
        if dataset in self.inline:
            return {f.name: f.dataType.simpleString() for f in self.frame(dataset).schema}
        return {f.name: f.dataType.simpleString() for f in self.catalog.get(dataset, self.workspace).schema}

    def _recorded(self, k: str, run) -> Result:  # noqa: ANN001
        try:
            with METRICS.timed("siltstone_query"):
                result = run()
            METRICS.count("siltstone_result_cache_total", hit=str(result.cache_hit).lower())
        except PySparkException as e:
            self.past.finish(k, error=str(e))
            raise EngineError(str(e)) from e
        except Exception as e:
            self.past.finish(k, error=str(e))
            raise
        self.past.finish(k, result.table.num_rows, cache_hit=result.cache_hit)
        return result

    def _run_sql(self, k: str, dataset: str, sql: str) -> Result:
        parsed = self.parse(dataset, sql)
        if parsed.plan is not None:
            return self._run(k, parsed.plan)
        return Result(self._direct(dataset, sql, parsed.tables).toArrow())

    def _run(self, k: str, plan: ir.Plan) -> Result:
        schemas = self._schemas(plan)
        ir.validate(plan, schemas)
        optimized = ir.optimize(plan, schemas)
        self.past.plan(k, ir.to_json(plan), ir.to_json(optimized))
        at = self._snapshot_key(plan)
        key = cache.key(ir.to_json(optimized), at)
        if (held := self.results.get(key, at)) is not None:
            return Result(held, plan, True)
        table = self.lowered(optimized).toArrow()
        self.results.put(key, at, table)
        return Result(table, plan)

    def explain(self, dataset: str, sql: str) -> Explained:
        """What a query would do; nothing runs and nothing is recorded."""
        parsed = self.parse(dataset, sql)
        if parsed.plan is None:
            files = [] if dataset in self.inline else self.catalog.manifests(self.catalog.current(self.catalog.get(dataset, self.workspace)))
            return Explained(None, None, "runs as Spark SQL", len(files), len(files), False, _physical(self._direct(dataset, sql, parsed.tables)))
        schemas = self._schemas(parsed.plan)
        ir.validate(parsed.plan, schemas)
        optimized = ir.optimize(parsed.plan, schemas)
        before = after = 0
        for scan, predicates in ir.scan_predicates(optimized).items():
            if scan.dataset in self.inline:
                continue
            files = self.catalog.manifests(self.catalog.snapshot(self.catalog.get(scan.dataset, self.workspace), scan.snapshot_id))
            before, after = before + len(files), after + len(pruning.prune(files, predicates))
        at = self._snapshot_key(parsed.plan)
        hit = self.results.has(cache.key(ir.to_json(optimized), at), at)
        return Explained(ir.to_dict(parsed.plan), ir.to_dict(optimized), ir.render(optimized), before, after, hit, _physical(self.lowered(optimized)))

    # --- profiles ---

    def summary(self, dataset: str) -> profile.Summary:
        return profile.summary(self.frame(dataset))

    def analyze(self, dataset: str, kind: str) -> object:
        if kind not in ("summary", "quality", "outlier", "trend"):
            raise EngineError(f"unknown analysis {kind!r}")
        return self.summary(dataset).to_dict() if kind == "summary" else self.insights(dataset, parts=(kind,)).get(kind)

    def insights(self, dataset: str, parts: tuple[str, ...] = ("quality", "outlier", "trend", "narration", "questions")) -> dict:
        """Summary and quality always; outliers and trend where there are columns for them; words where there is a provider."""
        df = self.frame(dataset)
        s = profile.summary(df)
        out: dict = {"summary": s.to_dict()}
        if "quality" in parts:
            out["quality"] = profile.quality(s, profile.duplicates(df.limit(SAMPLE)))
        group, value, time = profile.pick_group(s), profile.pick_value(s), profile.pick_time(s)
        if "outlier" in parts and group and value:
            found = profile.outlier_groups(profile.by_group(df, group, value), "group", "value").collect()
            out["outlier"] = {"group_column": group, "value_column": value, "groups": [r.asDict() for r in found]}
        if "trend" in parts and time and value:
            found = profile.trend(profile.by_time(df, time, value), "time", "value").first()
            if found:
                out["trend"] = {"time_column": time, "value_column": value} | found.asDict()
        if self.provider is not None and "narration" in parts:
            out["narration"] = nl.narrate_findings(json.dumps(out, default=str), self.provider)
        if self.provider is not None and "questions" in parts:
            out["questions"] = nl.suggest(dataset, self._types(dataset), json.dumps(s.to_dict(), default=str), self.provider)
        return out

    def research(self, dataset: str, question: str, corpus: str = "") -> research.State:
        return research.investigate(question, dataset, lambda q: self.query_nl(dataset, q).rows(), self.corpora.retrieve, self._model(), corpus)

    def history(self, n: int = 100) -> list[dict]:
        return self.past.newest(self.workspace, n)


def _plain(path: str) -> str:
    """One spelling of a local file's address."""
    return re.sub("^file:/+", "/", path)


def _hive_value(path: str, column: str, kind: T.DataType) -> object:
    """A partition's value, from the folder's name."""
    from urllib.parse import unquote

    m = re.search(rf"/{re.escape(column)}=([^/]*)/", unquote(path))
    text = m[1] if m else "__HIVE_DEFAULT_PARTITION__"
    return None if text == "__HIVE_DEFAULT_PARTITION__" else external._partition_value(text, kind)


def _physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def query_file(spark: SparkSession, path: str, sql: str) -> pa.Table:
    """SQL over one CSV or Parquet file, without a catalog; the file's table is t."""
    for k, v in CONF.items():
        spark.conf.set(k, v)
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else csv.read(spark, path)
    parsed = sqlfront.parse(spark, sql, "t", df.columns)
    if parsed.plan is not None:
        ir.validate(parsed.plan, {"t": df.columns})
        return lower.lower(parsed.plan, lambda s: df).toArrow()
    if set(parsed.tables) - {"t"} and not re.match(r"(?i)\s*with\b", sql):
        raise UnsupportedSql("the file's table is called t")
    df.createOrReplaceTempView("t")
    return spark.sql(sql).toArrow()
