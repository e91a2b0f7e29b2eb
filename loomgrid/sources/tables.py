"""Readers and writers, and the checkpoint of iterative jobs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Template formats.
FORMATS = ["top_bottom", "side_by_side", "three_panel", "four_panel", "single_text", "label_objects", "caption_below", "list", "custom"]
_REGION = "struct<label:string,x:int,y:int,width:int,height:int,font_size:int,color:string,stroke_color:string,stroke_width:int,align:string>"
_TEMPLATE = (
    "struct<name:string,filename:string,format:string,emotions:array<string>,tags:array<string>,humor_convention:string,typical_uses:array<string>,"
    f"text_regions:array<{_REGION}>,width:int,height:int,year_origin:int,is_classic:boolean>"
)
_POINT = "struct<lat:double,lon:double>"
_ELEMENT = f"struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,geometry:array<{_POINT}>,members:array<struct<type:string,ref:bigint,role:string,geometry:array<{_POINT}>>>,center:{_POINT}>"
RECIPES = ["castle", "church", "canopy", "trainshed", "palazzo", "tower_block", "monument"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine may it be unset; there it is a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-loomgrid-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


_FOLDERS: dict[str, SparkSession] = {}


def run_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared one; what is stored in it goes when the driver ends, or with release()."""
    path = f"{shared_folder(spark)}/loomgrid-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        if not _FOLDERS:
            atexit.register(release)
        _FOLDERS[path] = spark
    return path


def release() -> None:
    """Delete the folders of stored tables; frames that read them can't be used afterwards."""
    while _FOLDERS:
        path, spark = _FOLDERS.popitem()
        if spark.sparkContext._jsc is not None:  # else the session has ended, and its folder stays for the cluster's cleaning
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the run's folder as Parquet and read again: compressed, and safe from lost executors."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete frames of stored() that nothing reads any more, so that rounds don't add up on disk."""
    for df in frames:
        for at in {f.rpartition("/")[0] for f in df.inputFiles() if "/loomgrid-" in f}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def present(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything, in whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def write_scripts(scripts: DataFrame, path: str, per_folder: int = 1000) -> None:
    """scripts (script_id, value) as a file a script with a line feed at its end, in folders that read_scripts takes as `path/*`.

    The file, or its folder, is named script_id=<id>; scripts of one id have a file each. On a disk or mount the tasks write the
    files themselves, some `per_folder` to a folder: Hadoop starts a process for each file's permissions there, and a folder a
    script takes longer to list than to read. Elsewhere Spark's writer gives each id a folder. A path that is there is an error.
    """
    spark = scripts.sparkSession
    if present(spark, path):
        raise FileExistsError(path)
    n = max(1, -(-scripts.count() // per_folder))
    dealt = scripts.select("script_id", "value").repartition(n, "script_id")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getScheme() != "file":
        dealt.write.option("maxRecordsPerFile", 1).partitionBy("script_id").text(path)
        return
    root = store.makeQualified(at).toUri().getPath()
    os.makedirs(f"{root}/{0:06d}")  # is there without scripts too

    def write(rows):
        folder, last, same = f"{root}/{TaskContext.get().partitionId():06d}", None, 0
        os.makedirs(folder, exist_ok=True)
        for row in rows:  # in an order that a second attempt finds again, so that it writes the same names
            same = same + 1 if row.script_id == last else 0
            last = row.script_id
            part = f"{folder}/.{uuid.uuid4().hex}"  # hidden from readers until it is whole
            with open(part, "wb") as f:
                f.write(f"{row.value or ''}\n".encode())
            os.replace(part, f"{folder}/script_id={last}{f'.{same}' if same else ''}.txt")

    dealt.sortWithinPartitions("script_id", "value").foreachPartition(write)


def read_scripts(spark: SparkSession, path: str, blank: str = "error") -> DataFrame:
    """script_id (the file), raw: a whole text a file. A blank file is an error, or with blank="drop" is left out."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("script_id"), F.col("value").alias("raw"))
    empty = F.regexp_replace("raw", r"(?U)\s+", "") == ""
    if blank == "drop":
        return texts.where(~empty)
    return texts.withColumn("raw", F.when(empty, F.raise_error(F.concat(F.lit("the script is empty: "), "script_id"))).otherwise(F.col("raw")))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """The entries of {"templates": [...]} files with defaults; entries that lack a required field, have an unknown one or an
    unknown format are left out. Text regions likewise take their defaults. A path that is not there is an empty catalogue."""
    if not present(spark, path):
        return spark.createDataFrame([], f"tpl_pos long, t {_TEMPLATE}").select("tpl_pos", "t.*")
    raw = spark.read.option("multiLine", True).schema("templates array<map<string,string>>").json(path)
    known = [f.split(":")[0] for f in _TEMPLATE[7:-1].replace(_REGION, "r").split(",")]
    entries = raw.select(F.posexplode("templates").alias("tpl_pos", "m")).where(F.size(F.array_except(F.map_keys("m"), F.array(*map(F.lit, known)))) == 0)

    def parsed(name: str, kind: str):
        return F.from_json(F.col("m")[name], kind)

    region = lambda r: F.struct(
        r["label"].alias("label"), *[r[k].alias(k) for k in ("x", "y", "width", "height")], F.coalesce(r["font_size"], F.lit(32)).alias("font_size"), F.coalesce(r["color"], F.lit("white")).alias("color"),
        F.coalesce(r["stroke_color"], F.lit("black")).alias("stroke_color"), F.coalesce(r["stroke_width"], F.lit(2)).alias("stroke_width"), F.coalesce(r["align"], F.lit("center")).alias("align"),
    )
    m = F.col("m")
    out = entries.select(
        F.col("tpl_pos").cast("long"), m["name"].alias("name"), m["filename"].alias("filename"), m["format"].alias("format"), parsed("emotions", "array<string>").alias("emotions"),
        parsed("tags", "array<string>").alias("tags"), m["humor_convention"].alias("humor_convention"), F.coalesce(parsed("typical_uses", "array<string>"), F.array().cast("array<string>")).alias("typical_uses"),
        F.transform(parsed("text_regions", f"array<{_REGION}>"), region).alias("text_regions"), F.coalesce(m["width"].try_cast("int"), F.lit(800)).alias("width"), F.coalesce(m["height"].try_cast("int"), F.lit(600)).alias("height"),
        F.coalesce(m["year_origin"].try_cast("int"), F.lit(2010)).alias("year_origin"), F.coalesce(m["is_classic"].try_cast("boolean"), F.lit(True)).alias("is_classic"),
    )
    needed = ["name", "filename", "format", "emotions", "tags", "humor_convention", "text_regions"]
    return out.dropna(subset=needed).where(F.col("format").isin(FORMATS))


def write_templates(templates: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Templates as {"templates": [...]} files that read_templates reads, each of a bounded share of the rows."""
    n = max(1, -(-templates.count() // per_file))
    packed = templates.withColumn("_file", F.pmod(F.xxhash64("name"), F.lit(n))).groupBy("_file").agg(F.sort_array(F.collect_list(F.struct(*templates.columns))).alias("templates"))
    packed.repartition(min(n, 200), "_file").write.mode("overwrite").partitionBy("_file").json(path)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """The `elements` of map files, gzipped or plain, with a fixed narrow schema.

    Of a file that is there both ways the gzipped one is read; a path that is not there has no elements.
    """
    if not path.endswith(".gz") and present(spark, f"{path}.gz"):
        path = f"{path}.gz"
    elif not present(spark, path):
        return spark.createDataFrame([], f"e {_ELEMENT}").select("e.*")
    return spark.read.option("multiLine", True).schema(f"elements array<{_ELEMENT}>").json(path).select(F.explode("elements").alias("e")).select("e.*")


def load_models(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """models (pos, osm, name, recipe, supersedes, params) -> one model for each osm, the last; and the osm ids they replace.

    An unknown recipe fails the job.
    """
    known = F.assert_true(F.col("recipe").isin(RECIPES), F.concat(F.lit("unknown recipe "), "recipe"))
    checked = models.withColumn("_ok", known).where("_ok IS NULL").drop("_ok").withColumn("name", F.coalesce("name", "osm"))
    last = checked.groupBy("osm").agg(F.max_by(F.struct("name", "recipe", "params"), "pos").alias("m")).select("osm", "m.*")
    return last, checked.select(F.explode("supersedes").alias("osm")).distinct()


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Layers in one Parquet table parted by layer."""
    frames = [df.withColumn("layer", F.lit(name)) for name, df in layers.items()]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    whole.write.mode("overwrite").partitionBy("layer").parquet(path)
