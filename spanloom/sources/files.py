"""Files of mixed formats: what they are, whether they may be read, and chats exported by other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes in hex, and the family.
MAGIC = [
    ("255044462D", "pdf"), ("504B0304", "zip"), ("504B0506", "zip"), ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("47494638", "image"),
    ("49492A00", "image"), ("4D4D002A", "image"), ("424D", "image"), ("1F8B08", "gzip"), ("D0CF11E0A1B11AE1", "ole"), ("7B5C727466", "rtf"), ("EFBBBF", "text"),
]
FAMILIES = {
    "text": ["txt", "md", "markdown", "log", "json", "jsonl", "xml", "yaml", "yml", "toml", "ini", "cfg", "env", "html", "htm", "css", "js", "ts", "py", "java", "c", "h", "cpp", "go", "rs", "rb", "sh", "sql", "tex", "srt"],
    "sheet": ["csv", "tsv", "xlsx", "xls"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp"],
    "document": ["pdf", "docx", "pptx", "rtf"],
}
MAX_BYTES = 50 << 20


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,10})$", 1))


def family(name: Column) -> Column:
    """text, sheet, image, document or other, by the extension."""
    out = F.lit("other")
    for k, found in FAMILIES.items():
        out = F.when(extension(name).isin(*found), k).otherwise(out)
    return out


def sniffed(content: Column) -> Column:
    """The family that the first bytes show; text where they show none and hold no zero byte."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(head.rlike("^(?:..)*00"), "binary").otherwise("text")
    for magic, kind in reversed(MAGIC):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def guarded(files: DataFrame) -> DataFrame:
    """files (path, length, content) with family, kind and error: null where the file may be read."""
    kind = sniffed(F.col("content"))
    out = files.withColumn("family", family(F.col("path"))).withColumn("kind", kind)
    clash = (F.col("family").isin("text") & F.col("kind").isin("binary", "image", "pdf", "zip", "ole", "gzip")) | ((F.col("family") == "image") & (F.col("kind") != "image"))
    return out.withColumn("error", F.when(F.col("length") > MAX_BYTES, "too_large").when(F.col("length") == 0, "empty").when(clash, "type_mismatch").when(F.col("family") == "other", "unsupported"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of the text files under a path that may be read."""
    files = spark.read.format("binaryFile").load(path)
    return guarded(files).filter("error is null and family in ('text', 'sheet')").select("path", F.decode("content", "UTF-8").alias("text"))


def provider(export: Column) -> Column:
    """tree, flat or null, by the keys of an exported chat."""
    return F.when(F.get_json_object(export, "$.mapping").isNotNull(), "tree").when(F.get_json_object(export, "$.chat_messages").isNotNull(), "flat")


_NODE = "struct<id:string,parent:string,message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>"


def tree_chats(exports: DataFrame, column: str = "export") -> DataFrame:
    """conv_id, turn, role, text of chats kept as a tree: the branch from the current node up to the root.

    The walk is a fold over at most as many steps as there are nodes, so a cycle ends too.
    """
    parsed = exports.select(F.from_json(column, f"struct<id:string,conversation_id:string,current_node:string,mapping:map<string,{_NODE}>>").alias("_e")).select(F.coalesce("_e.conversation_id", "_e.id").alias("conv_id"), "_e.current_node", "_e.mapping")
    zero = F.struct(F.col("current_node").alias("at"), F.array().cast("array<string>").alias("path"))

    def step(s: Column, _: Column) -> Column:
        stop = s["at"].isNull() | F.array_contains(s["path"], s["at"])
        return F.when(stop, s).otherwise(F.struct(F.element_at(F.col("mapping"), s["at"])["parent"].alias("at"), F.array_append(s["path"], s["at"]).alias("path")))

    path = F.aggregate(F.map_keys("mapping"), zero, step, lambda s: F.reverse(s["path"]))
    nodes = parsed.select("conv_id", F.posexplode(F.transform(path, lambda k: F.element_at(F.col("mapping"), k)["message"])).alias("_i", "_m"))
    text = F.array_join(F.filter(F.col("_m.content.parts"), lambda p: p.isNotNull() & (F.trim(p) != "")), "\n")
    told = nodes.select("conv_id", "_i", F.col("_m.author.role").alias("role"), text.alias("text")).filter("role in ('user', 'assistant') and text <> ''")
    from pyspark.sql import Window

    return told.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("_i")) - 1).alias("turn"), "role", "text")


def flat_chats(exports: DataFrame, column: str = "export") -> DataFrame:
    """conv_id, turn, role, text of chats kept as a list of messages."""
    kind = "struct<uuid:string,chat_messages:array<struct<sender:string,text:string,content:array<struct<type:string,text:string>>>>>"
    parsed = exports.select(F.from_json(column, kind).alias("_e")).select(F.col("_e.uuid").alias("conv_id"), F.posexplode("_e.chat_messages").alias("turn", "_m"))
    blocks = F.array_join(F.transform(F.filter("_m.content", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return parsed.select("conv_id", "turn", F.when(F.col("_m.sender") == "human", "user").otherwise(F.col("_m.sender")).alias("role"), F.coalesce(F.nullif(blocks, F.lit("")), F.col("_m.text"), F.lit("")).alias("text"))
