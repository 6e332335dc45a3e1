"""Raw API responses: one envelope per payload file.

A payload directory tree (``batch_*/payloads/*.json`` or a flat ``payloads/*.json``)
is read in one distributed pass.  The body stays schemaless (VARIANT); everything
else about the envelope is typed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.functions import routing
from dqloom.functions import variant as V

# Layout of a payload file and of the stored envelope.
PAYLOAD_FIELDS = {
    "endpoint": "string",
    "http_status": "int",
    "request_params": "map<string,string>",
    "response_json": "variant",
    "source_file": "string",
}
ENVELOPE_COLUMNS = (
    "endpoint",
    "entity",
    "http_status",
    "request_params",
    "body",
    "run_id",
    "batch_id",
    "source_file",
    "load_ts",
)
# The batch layout, the flat layout, and http statuses that are fine.
BATCH_GLOB, FLAT_GLOB = "batch_*/payloads/*.json", "payloads/*.json"
# Layout of batches written by Spark itself.
PARTITION_GLOB = "batch_no=*/*.json"
LAYOUTS = (BATCH_GLOB, FLAT_GLOB, PARTITION_GLOB)
BATCH_DIR = "'/(batch_[^/]+)/'"
HTTP_OK = "http_status BETWEEN 200 AND 299"


class BrokenPayloads(ValueError):
    """Payload files that are no JSON object, or batches without any payload."""


def payload_texts(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Raw payload texts ``value`` of a run folder with their path ``_path``; raises when there are none.

    By default a file is one payload spread over many lines; ``lines`` reads files
    that hold one payload per line and can therefore be split.
    """
    folder = folder.rstrip("/")
    for glob in LAYOUTS:
        try:
            scan = spark.read.text(f"{folder}/{glob}", wholetext=not lines)
            return scan.select("value", F.col("_metadata.file_path").alias("_path"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no payload files under {folder}")


def parsed(texts: DataFrame) -> DataFrame:
    """Payload texts as ``_payload`` (VARIANT) with ``_broken``: empty, malformed or no object; NULL when sound."""
    payload = F.try_parse_json("value")
    return texts.withColumn("_payload", payload).withColumn(
        "_broken",
        F.when(F.btrim(F.coalesce("value", F.lit(""))) == "", "empty")
        .when(F.col("_payload").isNull(), "malformed")
        .when(~V.is_object(F.col("_payload")), "no object"),
    )


def payload_errors(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Files that hold no payload, ``path, reason``; batch directories without any file have the reason ``no files``.

    With ``lines`` an empty line is no payload and no error.
    """
    found = parsed(payload_texts(spark, folder, lines)).filter("_broken IS NOT NULL")
    if lines:
        found = found.filter("_broken <> 'empty'")
    bare = batch_folders(spark, folder).join(
        payload_texts(spark, folder, lines).select(F.regexp_extract("_path", "/(batch_[^/]+)/", 1).alias("batch")).distinct(), "batch", "left_anti"
    )
    return found.select(F.col("_path").alias("path"), F.col("_broken").alias("reason")).unionByName(
        bare.select("path", F.lit("no files").alias("reason"))
    )


def batch_folders(spark: SparkSession, folder: str) -> DataFrame:
    """The batch directories of a run folder, ``batch, path, no``, numbered by name; from a listing, no file is read."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/batch_*")
    listing = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or ()
    names = sorted((s.getPath().getName(), s.getPath().toString()) for s in listing if s.isDirectory())
    rows = [(name, path, number) for number, (name, path) in enumerate(names, 1)]
    return spark.createDataFrame(rows, "batch STRING, path STRING, no INT")


def read_payloads(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Sound payloads of a run folder with their path; broken ones are in ``payload_errors``."""
    return sound_payloads(parsed(payload_texts(spark, folder, lines)))


def sound_payloads(texts: DataFrame) -> DataFrame:
    """The typed fields of parsed payload texts that are JSON objects."""
    fields = [V.get(F.col("_payload"), name, kind=kind).alias(name) for name, kind in PAYLOAD_FIELDS.items()]
    return texts.filter("_broken IS NULL").select(*fields, "_path")


def read_envelopes(spark: SparkSession, folder: str, run_id: str, lines: bool = False) -> DataFrame:
    """Envelopes of one run with defaults filled in and batches numbered by directory order."""
    raw = read_payloads(spark, folder, lines).selectExpr(
        "* EXCEPT (source_file)",
        "coalesce(source_file, regexp_extract(_path, '([^/]+)$', 1)) AS source_file",
        f"regexp_extract(_path, {BATCH_DIR}, 1) AS _dir",
    )
    numbers = batch_folders(spark, folder).select(F.col("batch").alias("_dir"), F.col("no").alias("_no"))
    named = raw.join(numbers, "_dir", "left").withColumn("batch_id", F.format_string(f"{run_id}_b%04d", F.coalesce("_no", F.lit(1))))
    return as_envelopes(named, run_id)


def as_envelopes(payloads: DataFrame, run_id: str) -> DataFrame:
    """Standard envelope columns from ``endpoint, http_status, request_params, response_json, batch_id, source_file``."""
    origin = F.create_map(
        F.lit("run_id"), F.lit(run_id), F.lit("batch_id"), F.col("batch_id"), F.lit("source_file"), F.col("source_file")
    )
    given = F.map_filter(
        F.coalesce("request_params", F.create_map().cast("map<string,string>")),
        lambda k, _: ~k.isin("run_id", "batch_id", "source_file"),
    )
    endpoint = F.coalesce("endpoint", F.lit(""))
    return payloads.select(
        endpoint.alias("endpoint"),
        routing.entity_of(endpoint).alias("entity"),
        F.coalesce("http_status", F.lit(200)).alias("http_status"),
        F.map_concat(given, origin).alias("request_params"),
        F.coalesce("response_json", F.parse_json(F.lit("{}"))).alias("body"),
        F.lit(run_id).alias("run_id"),
        "batch_id",
        "source_file",
        F.current_timestamp().alias("load_ts"),
    )


def text_envelopes(df: DataFrame) -> DataFrame:
    """Envelopes whose body column is JSON text."""
    return df.withColumn("body", V.body(F.col("body")))


def good(envelopes: DataFrame) -> DataFrame:
    return envelopes.filter(HTTP_OK)


def latest_per_entity(envelopes: DataFrame) -> DataFrame:
    """The newest good payload of every entity.

    The newest is found on the narrow columns, in an aggregate; then only the few bodies it names are fetched.
    """
    place = ("load_ts", "batch_id", "source_file", "run_id", "endpoint")
    own = good(envelopes).filter("entity IS NOT NULL")
    newest = own.select("entity", *place).groupBy("entity").agg(F.max(F.struct(*place)).alias("r"))
    named = newest.select(F.col("entity").alias("_entity"), *[F.col(f"r.{c}").alias(f"_{c}") for c in place])
    fetched = own.join(named, F.expr(" AND ".join(f"{c} <=> _{c}" for c in ("entity", *place))), "left_semi")
    # one row per entity even where a payload is stored twice
    return fetched.select("entity", "endpoint", "body", "run_id", "batch_id", "source_file").dropDuplicates(["entity"])


def newest_run_folder(spark: SparkSession, root: str, pattern: str = "*") -> str | None:
    """Run folder below ``root`` holding the most recently written payload."""
    folder = F.regexp_replace("path", "/(batch_[^/]+/)?(payloads/)?[^/]+$", "").alias("folder")
    found = None
    for glob in LAYOUTS:
        try:
            files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{pattern}/{glob}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        # Only the listing is read: the content column is pruned.
        newest = files.groupBy(folder).agg(F.max("modificationTime").alias("ts"))
        found = newest if found is None else found.unionByName(newest)
    row = found.orderBy(F.desc("ts"), F.desc("folder")).head() if found is not None else None
    return row["folder"] if row else None


def main_run(envelopes: DataFrame, preferred_prefix: str = "manual__") -> DataFrame:
    """The run to export: a preferred one if any, then the one with most rows, then the newest."""
    runs = envelopes.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.max("load_ts").alias("last_load"))
    preferred = F.col("run_id").startswith(preferred_prefix)
    return runs.orderBy(preferred.desc(), F.desc("rows"), F.desc("last_load"), "run_id").limit(1)


def stage_e_tables(envelopes: DataFrame, run_id: str | None = None) -> dict[str, DataFrame]:
    """Inputs of the extract-stage suite: good match payloads and their (still textual) elements."""
    ok = good(envelopes).filter("entity = 'matches'")
    if run_id is not None:
        ok = ok.filter(F.col("run_id") == run_id)
    numbered = ok.withColumn("id", F.concat_ws("/", "batch_id", "source_file"))
    # Outer and filtered afterwards, see flatten.unrolled.
    items = numbered.select("id", "endpoint", F.explode_outer(V.elements(F.col("body"), "matches")).alias("m")).filter("m IS NOT NULL")
    return {
        "stg_payloads": numbered.select("id", "endpoint", "http_status", V.has_key(F.col("body"), "matches").alias("has_key")),
        "stg_matches": items.select(
            "id", "endpoint", V.get(F.col("m"), "id").alias("match_id"), V.get(F.col("m"), "matchday").alias("matchday")
        ),
    }


def copy_run(envelopes: DataFrame, source_run: str, target_run: str, mutate=None) -> DataFrame:
    """The good payloads of a run under a new run id.

    Payloads of a known entity that lack the entity's list are left out.
    ``mutate`` optionally transforms the copied envelopes.
    """
    keyed = F.lit(False)
    for entity in routing.ENDPOINT_PATTERNS:
        keyed = keyed | ((F.col("entity") == entity) & V.has_key(F.col("body"), entity))
    kept = good(envelopes).filter(F.col("run_id") == source_run).filter(F.col("entity").isNull() | keyed)
    params = F.map_concat(
        F.map_filter("request_params", lambda k, _: ~k.isin("run_id", "source_run_id")),
        F.create_map(F.lit("run_id"), F.lit(target_run), F.lit("source_run_id"), F.lit(source_run)),
    )
    copied = kept.withColumns({"request_params": params, "run_id": F.lit(target_run), "load_ts": F.current_timestamp()})
    return mutate(copied) if mutate else copied
