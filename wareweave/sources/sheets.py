"""Product sheets in and out: reading, header names, records, result tables."""

from __future__ import annotations

from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareweave.functions.money import ERROR_CELLS

# Header names of product sheets and what they mean.
ALIASES = {
    "Code": "상품Code", "상품코드": "상품Code", "상품 코드": "상품Code", "상품번호": "상품Code",
    "상품이름": "상품명", "상품 이름": "상품명", "제품명": "상품명",
    "판매가(V포함)": "판매단가(V포함)", "판매가(VAT포함)": "판매단가(V포함)", "판매가": "판매단가(V포함)",
    "가격": "판매단가(V포함)", "가격(V포함)": "판매단가(V포함)",
    "본사링크": "본사상품링크", "상품링크": "본사상품링크", "URL": "본사상품링크",
    "수량": "기본수량(1)", "기본수량": "기본수량(1)",
    "이미지": "본사 이미지", "이미지URL": "본사 이미지", "제품이미지": "본사 이미지", "상품이미지": "본사 이미지",
}
ALTERNATIVES = {
    "상품명": ("품명", "제품명", "상품", "product", "name", "item", "품목", "상품이름", "제품"),
    "판매단가(V포함)": ("판매단가", "단가(VAT포함)", "단가(V포함)", "판매가", "판매가격", "가격", "price", "가격(V포함)", "판매 단가"),
    "상품Code": ("상품코드", "제품코드", "품목코드", "product code", "code", "코드", "sku", "제품 코드"),
    "본사 이미지": ("이미지", "이미지링크", "이미지 URL", "상품이미지", "image", "image url", "이미지주소", "본사이미지", "이미지 링크"),
    "본사상품링크": ("상품링크", "제품링크", "링크", "url", "product url", "상품 URL", "본사 상품링크", "본사링크", "제품 링크"),
}
#: Headers of a price table.
TIER_HEADERS = ("수량", "일반")
PRODUCT = "struct<id:string,name:string,source:string,price:double,brand:string,category:string>"


def java_charset(encoding: str) -> str:
    """Java's name of an encoding; its own CP949 lacks most syllables that Windows' has."""
    return "MS949" if encoding.upper() in ("CP949", "UHC", "MS949") else encoding


def files_not_utf8(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder that hold bytes that are no UTF-8; their names only come back."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("f"))
    return sorted(r["f"] for r in broken.distinct().collect())


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str | None = None, corrupt: str | None = None) -> DataFrame:
    """Sheets exported as CSV, each file in its own encoding; error cells are null.

    Without an encoding a file is UTF-8, or CP949 if it holds bytes that are no UTF-8, which
    takes a pass over the bytes. Files of both kinds become one table: by name, and where one
    lacks a column by null. With a schema, ``corrupt`` names a column that keeps
    the text of rows that do not fit it. Spark reads other than the standard
    encodings only with its setting for Java charsets, which is switched on for the session then.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if corrupt and schema is None:
        raise ValueError("a column for corrupt rows needs a schema")
    own = schema

    def reader(charset: str):
        if charset.upper() not in ("UTF-8", "UTF8"):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        found = spark.read.option("header", True).option("encoding", java_charset(charset))
        if corrupt:
            found = found.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
        return found.schema(T.StructType([*own.fields, T.StructField(corrupt, T.StringType())]) if corrupt else own) if own else found

    if encoding is not None:
        return null_errors(reader(encoding).csv(path))
    older = files_not_utf8(spark, path)
    if not older:
        return null_errors(reader("UTF-8").csv(path))
    rest = reader("UTF-8").csv(path).filter(~F.col("_metadata.file_path").isin(older))
    return null_errors(rest.unionByName(reader("CP949").csv([_as_path(f) for f in older]), allowMissingColumns=True))


def _as_path(url: str) -> str:
    """A file's name as Spark's readers take it: percent signs of the URL resolved."""
    return unquote(url)


def null_errors(df: DataFrame) -> DataFrame:
    """Null the cells that hold a spreadsheet's error text."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: F.when(~F.trim(c).isin(*ERROR_CELLS), F.col(c)) for c in texts})


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """Canonical name -> sheet column, for names that the sheet does not have itself.

    Aliases come first. A required name that is still missing goes to the column equal
    but for case, else by the order of its alternatives to the first column that holds
    one as a part. A column may stand for several names.
    """
    found = {c.strip(): c for c in columns}
    for alias, name in ALIASES.items():
        if alias in found and name not in found:
            found[name] = found[alias]
    for name, others in ALTERNATIVES.items():
        if name not in found:
            same = [c for n, c in found.items() if n.lower() == name.lower()]
            like = [c for o in others for n, c in found.items() if o.lower() in n.lower()]
            if same or like:
                found[name] = (same or like)[0]
    return {n: c for n, c in found.items() if n in ALTERNATIVES or n in ALIASES.values()}


def harmonize(df: DataFrame, key: str, source: str) -> DataFrame:
    """The sheet with its own columns and the canonical ones; missing ones get 0, GEN-key or ''."""
    found = resolve_headers(df.columns)
    defaults = {"판매단가(V포함)": F.lit(0.0), "상품Code": F.concat(F.lit("GEN-"), F.col(key).cast("string"))}
    added = {n: F.col(f"`{c}`") for n, c in found.items() if n not in df.columns}
    added |= {n: defaults.get(n, F.lit("")) for n in ALTERNATIVES if n not in found}
    if "source" not in df.columns:
        added["source"] = F.lit(source)
    return df.withColumns(added)


def _common_type(kinds: set[str]) -> str:
    """The type that holds all values of the given ones: equal, the wider number, else text."""
    order = ("tinyint", "smallint", "int", "bigint", "float", "double")
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= set(order):
        return "double" if kinds & {"float", "double"} else max(kinds, key=order.index)
    return "string"


def harmonize_sheets(sheets: dict[str, DataFrame], key: str) -> DataFrame:
    """Several sheets of their own headers as one table: canonical columns, own ones, and ``source``.

    Every sheet is harmonised; a column whose type differs between sheets gets one that
    holds all values; columns that a sheet lacks are null in it. Names that differ in case or
    outer blanks only are one column.
    """
    ready = {}
    for name, df in sheets.items():
        df = df.toDF(*[c.strip() for c in df.columns])
        ready[name] = harmonize(df, key, name)
    spelt: dict[str, str] = {}
    kinds: dict[str, set[str]] = {}
    for df in ready.values():
        for c, kind in df.dtypes:
            kinds.setdefault(spelt.setdefault(c.lower(), c), set()).add(kind)
    wanted = {c: _common_type(set(k)) for c, k in kinds.items()}
    alike = lambda df: df.select(*[F.col(f"`{c}`").cast(wanted[spelt[c.lower()]]).alias(spelt[c.lower()]) for c in df.columns])
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), map(alike, ready.values()))


def strip_at(df: DataFrame) -> DataFrame:
    """Every text column without the sign @."""
    return df.withColumns({c: F.translate(c, "@", "") for c, kind in df.dtypes if kind == "string"})


def missing_columns(df: DataFrame, required: tuple[str, ...] = ("상품명", "판매단가(V포함)")) -> list[str]:
    return [c for c in required if c not in df.columns]


def parse_items(df: DataFrame, column: str) -> DataFrame:
    """Products of search results in JSON: tags stripped, id or the link's MD5, category path."""
    schema = "title string, lprice string, productId string, link string, category1 string, category2 string, image string"
    item = F.from_json(column, schema)
    x = df.select("*", item.alias("item"))
    return x.select(
        *df.columns,
        F.regexp_replace("item.title", "<[^>]+>", "").alias("name"),
        F.col("item.lprice").try_cast("long").alias("price"),
        F.coalesce(F.nullif(F.col("item.productId"), F.lit("")), F.md5(F.col("item.link").cast("binary"))).alias("id"),
        F.concat_ws(" > ", F.nullif(F.col("item.category1"), F.lit("")), F.nullif(F.col("item.category2"), F.lit(""))).alias("category"),
        F.regexp_replace("item.image", "^http:", "https:").alias("image"),
    ).drop(column)


def to_record(df: DataFrame) -> DataFrame:
    """A product as JSON text without its empty optional fields."""
    some = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return df.select("id", F.to_json(F.struct("id", "name", "source", "price", some("brand"), some("category")), {"ignoreNullFields": "true"}).alias("record"))


def from_record(df: DataFrame) -> DataFrame:
    """Products of JSON text; records without a required field are dropped."""
    return df.select(F.from_json("record", PRODUCT).alias("p")).select("p.*").dropna(subset=["id", "name", "source", "price"])


def write_table(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write a result table as Parquet, partitioned by a column, and read it again."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """A report as CSV with a header."""
    if encoding.upper() != "UTF-8":
        df.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    df.write.mode("overwrite").option("header", True).option("encoding", java_charset(encoding)).csv(path)


def merge_folder(spark: SparkSession, path: str) -> DataFrame:
    """All part tables below a folder as one; columns that a part lacks are null, empty parts add nothing."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)


def resume_at(df: DataFrame, seq: str, links: tuple[str, ...]) -> DataFrame:
    """(seq,): the first row in order in which all links are empty; none if there is no such row."""
    return df.filter(reduce(and_, [F.col(c).isNull() for c in links])).select(seq).orderBy(seq).limit(1)


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that no done-log row names."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def write_parts(parts: DataFrame, path: str, label: str, seq: str) -> None:
    """One CSV file for each part, below a folder named by the part's label, its rows in order.

    parts: with part, as from split_parts. A part is bounded, so a task writes its file
    whole; parts are dealt over the tasks by their number and label. By the number alone, the
    exchange would be left out after a join by part, which may become a broadcast while it
    runs and then leaves a part's rows where they were.
    """
    ordered = parts.repartition("part", label).sortWithinPartitions("part", seq)
    ordered.write.mode("overwrite").partitionBy(label).option("header", True).csv(path)


def list_parts(spark: SparkSession, path: str, label: str, schema: str) -> DataFrame:
    """(label, files, rows) of the part files below a folder, counted from the files."""
    read = spark.read.option("header", True).schema(f"{schema}, {label} string").csv(path)
    return read.groupBy(label).agg(F.count_distinct("_metadata.file_path").alias("files"), F.count(F.lit(1)).alias("rows"))


RUN = "run_id"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_run(df: DataFrame, path: str, run_id: str) -> bool:
    """Append a run's rows once: False if the run is already complete, and nothing is written.

    The rows replace the run's own partition, so what a broken run left is overwritten and other
    runs stay. The run's row in the done-log is written last: without it the run does not count.
    """
    spark = df.sparkSession
    marker = f"{path}/done/{RUN}={run_id}"
    if _exists(spark, f"{marker}/_SUCCESS"):
        return False
    rows = df.withColumn(RUN, F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(f"{path}/rows")
    count = spark.read.parquet(f"{path}/rows").filter(F.col(RUN).cast("string") == run_id).count()
    spark.range(1).select(F.lit(count).alias("rows")).write.mode("overwrite").parquet(marker)
    return True


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of complete runs, with run_id; those of runs that broke off are left out."""
    whole = T.StructType([*schema.fields, T.StructField(RUN, T.StringType())])
    done = spark.read.schema(f"rows long, {RUN} string").parquet(f"{path}/done").select(RUN)
    return spark.read.schema(whole).parquet(f"{path}/rows").join(done, RUN, "left_semi").select(*whole.names)


def write_tiers(tiers: DataFrame, path: str, by: str) -> None:
    """Price tables as CSV, quantity and price under their usual headers, in order of quantity, a folder for each ``by``."""
    quantity, price = TIER_HEADERS
    named = tiers.select(by, F.col("qty").alias(quantity), F.col("unit_price").alias(price))
    named.repartition(by).sortWithinPartitions(by, quantity).write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def read_tiers(spark: SparkSession, path: str, by: str, kind: str = "string") -> DataFrame:
    quantity, price = TIER_HEADERS
    found = spark.read.option("header", True).schema(f"`{quantity}` int, `{price}` double, {by} {kind}").csv(path)
    return found.select(by, F.col(quantity).alias("qty"), F.col(price).alias("unit_price"))
