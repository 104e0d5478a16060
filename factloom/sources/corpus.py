"""Reading and writing corpora, snapshots and stage outputs (IO1 to IO3, IO10 to IO26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import ids as I
from ..functions import text as X

BLOCK = "struct<type: string, level: int, text: string, cells: string, caption: string, speaker: string, timestamp: string, label: string, page_number: int, section_label: string, paragraph_index: int>"
DOCUMENT = f"struct<id: string, corpus_version: string, title: string, source_url: string, publisher: string, document_date: string, visibility: string, source_citation_label: string, metadata: string, content_markdown: string, blocks: array<{BLOCK}>>"
CORPUS = f"corpus_version string, metadata map<string, string>, documents array<{DOCUMENT}>"
CASES = "id string, expected struct<verdict: string, attribution: map<string, string>, evidence_ids: array<string>, required_passage_ids: array<string>, relevant_url_ids: array<string>, primary_source_ids: array<string>, citation_entailment: map<string, string>, extracted_fields: map<string, string>, numerical_checks: map<string, string>, duplicate_clusters: array<array<string>>>, predicted struct<verdict: string, attribution: map<string, string>, evidence_ids: array<string>, required_passage_ids: array<string>, relevant_url_ids: array<string>, primary_source_ids: array<string>, citation_entailment: map<string, string>, extracted_fields: map<string, string>, numerical_checks: map<string, string>, duplicate_clusters: array<array<string>>, confidence: double, verdict_probabilities: map<string, double>, statement_count: int, unsupported_statement_count: int, latency_seconds: double, cost_usd: double>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """IO1: the documents of a JSON corpus, one row each; visibility is public unless given."""
    raw = spark.read.schema(CORPUS).json(path, multiLine=True)
    d = raw.select(F.col("corpus_version").alias("__v"), F.explode("documents").alias("d")).select("__v", "d.*")
    return d.withColumn("corpus_version", F.coalesce("corpus_version", "__v")).drop("__v").withColumn("visibility", F.coalesce("visibility", F.lit("public"))).withColumn("document_date", F.col("document_date").try_cast("date"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """IO2: a file is a document; its id is the slug of the file's name, its title the first heading."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("content_markdown"), F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*?)(\.[^.]*)?$", 1).alias("name"))
    title = F.nullif(F.trim(F.regexp_extract("content_markdown", r"(?m)^\s*#\s+(.+)$", 1)), F.lit(""))
    return raw.select(X.slug(F.col("name")).alias("id"), F.coalesce(title, "name").alias("title"), "content_markdown")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """IO25."""
    return spark.read.schema(CASES).json(path, multiLine=True)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """IO12: stored bodies with their hash; intact: the content still has the hash that names the file."""
    raw = spark.read.format("binaryFile").load(path)
    named = F.regexp_extract("path", r"([0-9a-f]{64})", 1)
    return raw.select(named.alias("content_hash"), "content", (F.sha2("content", 256) == named).alias("intact"))


def write_snapshots(bodies: DataFrame, path: str, content: str = "content") -> None:
    """IO12, IO13: bodies by their content's hash, each once, in folders of the hash's first two digits."""
    b = bodies.withColumn("content_hash", F.sha2(F.col(content), 256)).dropDuplicates(["content_hash"])
    b.withColumn("prefix", F.substring("content_hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def cached(df: DataFrame, path: str) -> DataFrame:
    """IO14: df, written at `path` the first time and read from there after; an unreadable cache counts as a miss."""
    spark = df.sparkSession
    try:
        return spark.read.schema(df.schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """IO15: stored and new rows, the latest of each key. A null time is the earliest; of equal times the new row wins, then the
    one with the larger hash."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__new")]
    last = F.struct(F.col(at).isNotNull(), F.col(at), F.col("__new"), F.xxhash64(*rest))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), last).alias("r")).select(*keys, "r.*")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """IO16 to IO21: the partitions that df has rows of are replaced, others stay: a stage that runs again leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def new_only(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """IO19."""
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def merged_sources(found: DataFrame) -> DataFrame:
    """IO18: one row for each canonical URL: first and last seen, first known title and domain."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seen_at")))
    return found.groupBy("canonical_url").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), first("title").alias("title"), first("domain").alias("domain"))


def json_export(report: DataFrame, id_: str) -> DataFrame:
    """IO22: id, canonical JSON (sorted keys, nulls kept) and its hash."""
    body = I.sorted_json(**{c: F.col(c) for c in report.columns})
    return report.select(id_, body.alias("body")).withColumn("sha256", I.sha256(F.col("body")))


def run_citations(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """IO23: a row for each citation of a run's sentences. runs: run_id, sentences array<struct<sentence_index, citation_ids>>."""
    s = runs.select("run_id", F.explode("sentences").alias("s")).select("run_id", "s.sentence_index", F.explode("s.citation_ids").alias("chunk_id"))
    return s.join(chunks.select("chunk_id", "document_id"), "chunk_id")


def metric_points(metrics: DataFrame) -> DataFrame:
    """IO24: points as JSON, to be appended."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))


def dataset_violations(cases: DataFrame, required: list[str], splits: list[str]) -> DataFrame:
    """IO26: (id, code) of missing fields and unknown splits."""
    codes = F.array(*[F.when(F.col(c).isNull(), f"MISSING_{c.upper()}") for c in required], F.when(~F.col("split").isin(splits), "UNKNOWN_SPLIT"))
    return cases.select("id", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))


#: First bytes of executables and archives, and the extensions of allowed uploads.
SIGNATURES = ["4D5A", "7F454C46", "504B0304", "FEEDFACE", "CFFAEDFE", "2321"]
UPLOADS = {"application/pdf": [".pdf"], "text/plain": [".txt"]}


def upload_error(name: Column, content_type: Column, body: Column, most: int) -> Column:
    """why an upload is refused, null if it isn't. body: binary."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    bad_name = F.coalesce(name, F.lit("")).isin("", ".", "..") | name.rlike(r"[/\\\x00-\x1f\x7f]") | (F.length(name) > 255)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    wrong = F.lit(False)
    for k, allowed in UPLOADS.items():
        wrong = wrong | ((kind == k) & ~suffix.isin(allowed))
    signed = F.lit(False)
    for x in SIGNATURES:
        signed = signed | F.startswith(F.hex(F.substring(body, 1, 4)), F.lit(x))
    text = F.try_validate_utf8(body.cast("string"))
    return (
        F.when(bad_name, "Upload filename is invalid").when(~kind.isin(list(UPLOADS)), "Upload content type is not supported").when(wrong, "Upload extension does not match its content type")
        .when(F.coalesce(F.octet_length(body), F.lit(0)) == 0, "Upload is empty").when(F.octet_length(body) > most, "Upload exceeds the configured size limit")
        .when(signed, "Executable or archive uploads are not supported").when((kind == "application/pdf") & (F.hex(F.substring(body, 1, 5)) != "255044462D"), "PDF signature does not match its content type")
        .when((kind == "text/plain") & text.isNull(), "Plain-text uploads must be valid UTF-8").when((kind == "text/plain") & text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "Binary control characters are not supported as text")
    )


def snapshot_status(code: Column, content_type: Column, size: Column, limit: int = 10_000_000) -> Column:
    """IO11: what remains of a fetch once it is a row."""
    return F.when(size > limit, "TOO_LARGE").when(code.between(200, 299), "FETCHED").otherwise("FETCH_FAILED")


class SearchResults(DataSource):
    """IO10: the place where a search client plugs in. Option `client`: module:function that gives result rows for a query key;
    option `keys`: comma-joined keys, one partition each."""

    @classmethod
    def name(cls) -> str:
        return "search_results"

    def schema(self) -> str:
        return "query_key string, rank int, url string, title string, snippet string, published_at string, profile string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(k) for k in self.options.get("keys", "").split(",") if k]

    def read(self, partition):
        import importlib

        module, _, function = self.options["client"].partition(":")
        seen = 0
        for row in getattr(importlib.import_module(module), function)(partition.value):
            seen += 1
            if seen > 20:
                break
            yield tuple(row)
