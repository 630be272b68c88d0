"""How the cells of a sheet become text: orientation, header row, records.

Cells are a long table (file, sheet, row, col, value) with rows and columns from 0. Every step groups by sheet, row or
column, so a sheet's size bounds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.lineage import settled
from factloom.sources.sheets import clean_cell

# Labels that identify a vehicle, and further ones that a matrix of vehicles has in its first column.
IDENTITY = ["品牌", "车系名称", "车型名称", "配置版本等级", "厂商指导价"]
SIGNALS = IDENTITY + ["车型", "一句话介绍", "车型价格区间", "细分品牌分类", "车辆级别", "能源类型", "购车补贴政策", "厂家置换补贴", "金融优惠", "其他权益", "其他活动"]
# Words of header cells.
HEADER_WORDS = ["车型", "品牌", "版本", "配置", "参数", "价格", "指导价", "权益", "政策", "内容", "名称", "序号", "项目", "说明", "时间", "日期", "适用范围", "适用版本", "备注", "续航", "轴距"]
# Least labels, identity rows, vehicle columns, values a column and share of signals of a matrix.
MIN_LABELS, MIN_IDENTITY, MIN_COLUMNS, MIN_VALUES, MIN_SHARE = 5, 3, 2, 3, 0.25
HEADER_ROWS, LONG_CELL = 20, 40
# Names of orientations and marks of the text.
MATRIX, ROWS, UNKNOWN = "COLUMN_ORIENTED_VEHICLE_MATRIX", "ROW_ORIENTED_TABLE", "UNKNOWN"
MATRIX_MARK, PREFACE_MARK = "【表格结构：横向车型矩阵】", "【前置信息】"

SHEET = ["file", "sheet"]


def cell_text(value: Column, kind: Column) -> Column:
    """A typed cell as text. Kinds: b (true or false), n (a number), d (a timestamp), any other is text."""
    number = value.try_cast("double")
    whole = F.format_string("%d", number.cast("long"))
    rounded = F.regexp_replace(F.format_string("%.8f", F.round(number, 8)), r"\.?0+$", "")
    when = value.try_cast("timestamp")
    day = (F.hour(when) == 0) & (F.minute(when) == 0)
    return (
        F.when((kind == "b") & value.isNotNull(), F.when(F.lower(value).isin("true", "1"), "是").otherwise("否"))
        .when((kind == "n") & number.isNotNull(), F.when(number == F.floor(number), whole).otherwise(rounded))
        .when((kind == "d") & when.isNotNull(), F.when(day, F.date_format(when, "yyyy-MM-dd")).otherwise(F.date_format(when, "yyyy-MM-dd HH:mm:ss")))
        .otherwise(F.regexp_replace(clean_cell(F.regexp_replace(value, "\r\n?", "\n")), r"(?U)^\s+|\s+$", ""))
    )


def filled(cells: DataFrame) -> DataFrame:
    """The cells that hold something, cleaned; every later step starts from these."""
    return cells.select(*SHEET, "row", "col", clean_cell(F.col("value")).alias("value")).where("value <> ''")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """The rows that hold something, numbered from 0 (index), each as its values up to the last filled one (values)."""
    found = filled(cells).groupBy(*SHEET, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("at"), F.max("col").alias("last"))
    values = F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda k: F.coalesce(F.try_element_at("at", k.cast("int")), F.lit("")))
    return found.withColumn("at", F.transform_keys("at", lambda k, _: k.cast("int"))).select(*SHEET, "row", (F.row_number().over(Window.partitionBy(*SHEET).orderBy("row")) - 1).alias("index"), values.alias("values"))


def label(value: Column) -> Column:
    return F.regexp_replace(value, r"[ \n\t]", "")


def vehicle_columns(cells: DataFrame) -> DataFrame:
    """Columns (file, sheet, col) that hold a vehicle: two values or more in identity rows, three or more in all. Of rows
    that share an identity label the last counts."""
    some = filled(cells)
    rows = some.where("col = 0").withColumn("label", label(F.col("value"))).where(F.col("label").isin(IDENTITY)).groupBy(*SHEET, "label").agg(F.max("row").alias("row"))
    marked = some.where("col >= 1").join(rows.select(*SHEET, "row", F.lit(1).alias("known")), [*SHEET, "row"], "left")
    return marked.groupBy(*SHEET, "col").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known")).where((F.col("known") >= 2) & (F.col("n") >= MIN_VALUES)).select(*SHEET, "col")


def orientation(cells: DataFrame) -> DataFrame:
    """Each sheet's orientation."""
    some = filled(cells)
    labels = some.where("col = 0").withColumn("label", label(F.col("value")))
    first = labels.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if(F.col("label").isin(SIGNALS)).alias("signals"),
        F.count_distinct(F.when(F.col("label").isin(IDENTITY), F.col("label"))).alias("known"),
    )
    vehicles = vehicle_columns(cells).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("vehicles"))
    sheets = some.select(*SHEET).distinct().join(first, SHEET, "left").join(vehicles, SHEET, "left")
    matrix = (F.col("labels") >= MIN_LABELS) & (F.col("known") >= MIN_IDENTITY) & (F.col("vehicles") >= MIN_COLUMNS) & (F.col("signals") / F.col("labels") >= MIN_SHARE)
    return sheets.select(*SHEET, F.when(matrix, MATRIX).otherwise(ROWS).alias("orientation"))


def header_rows(rows: DataFrame) -> DataFrame:
    """From sheet_rows: each sheet's likeliest header row (index) among its first HEADER_ROWS; sheets without a row of two
    values are absent."""
    some = F.filter("values", lambda v: v != "")
    n = F.size(some)
    worded = F.filter(some, lambda v: ~v.rlike(r"^(?=.*[0-9])[0-9]*\.?[0-9]*$"))
    known = F.filter(some, lambda v: F.exists(F.array(*(F.lit(w) for w in HEADER_WORDS)), lambda w: F.contains(F.replace(v, F.lit(" "), F.lit("")), w)))
    long = F.filter(some, lambda v: F.length(v) > LONG_CELL)
    after = F.lead(n).over(Window.partitionBy(*SHEET).orderBy("index"))
    scored = rows.select(*SHEET, "index", n.alias("n"), (3 * n + F.size(worded) + 4 * F.size(known) - 3 * F.size(long)).alias("own"), after.alias("after"))
    scored = scored.where((F.col("index") < HEADER_ROWS) & (F.col("n") >= 2)).withColumn("score", F.col("own") + F.when(F.col("after") >= 2, 2 * F.least("after", "n")).otherwise(0))
    return scored.groupBy(*SHEET).agg(F.max_by("index", F.struct("score", -F.col("index"))).alias("index"))


def matrix_records(cells: DataFrame) -> DataFrame:
    """A matrix's vehicles as records, in column order: file, sheet, record (from 1), text of 'label: value' lines; labels
    that repeat get _2, _3 and so on, counted over the vehicle's own values."""
    some = filled(cells)
    labels = some.where("col = 0").select(*SHEET, "row", F.trim("value").alias("label"))
    rows = some.join(vehicle_columns(cells), [*SHEET, "col"]).join(labels, [*SHEET, "row"])
    k = F.row_number().over(Window.partitionBy(*SHEET, "col", "label").orderBy("row"))
    rows = rows.withColumn("k", k).withColumn("line", F.concat("label", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(""), F.lit(": "), "value"))
    texts = rows.groupBy(*SHEET, "col").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", "line")))["line"], "\n").alias("text"))
    return texts.select(*SHEET, F.row_number().over(Window.partitionBy(*SHEET).orderBy("col")).alias("record"), "text")


def _lines(names: Column, values: Column) -> Column:
    """'name: value' lines of the values that are there."""
    both = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.coalesce(x["v"], F.lit("")) != "")
    return F.array_join(F.transform(both, lambda x: F.concat(x["n"], F.lit(": "), x["v"])), "\n")


def header_names(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Each sheet's column names: its header row's values, blanks named by place, repeats numbered, as wide as the widest
    row from the header on."""
    below = rows.join(headers.withColumnRenamed("index", "top"), SHEET).where("index >= top")
    wide = below.groupBy(*SHEET).agg(F.max(F.size("values")).alias("width"), F.max(F.when(F.col("index") == F.col("top"), F.col("values"))).alias("values"))
    cells = wide.select(*SHEET, F.explode(F.sequence(F.lit(1), "width")).alias("place"), "values").withColumn("own", F.trim(F.coalesce(F.get("values", F.col("place") - 1), F.lit(""))))
    cells = cells.withColumn("own", F.when(F.col("own") == "", F.concat(F.lit("字段"), F.col("place").cast("string"))).otherwise(F.col("own")))
    cells = cells.withColumn("k", F.row_number().over(Window.partitionBy(*SHEET, "own").orderBy("place")))
    name = F.concat("own", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(""))
    return cells.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("place", name.alias("name"))))["name"].alias("names"))


def table_records(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The rows below a sheet's header as records: file, sheet, record (from 1), text."""
    below = rows.join(headers.withColumnRenamed("index", "top"), SHEET).where("index > top").join(header_names(rows, headers), SHEET)
    texts = below.select(*SHEET, "index", _lines(F.col("names"), F.col("values")).alias("text")).where("text <> ''")
    return texts.select(*SHEET, F.row_number().over(Window.partitionBy(*SHEET).orderBy("index")).alias("record"), "text")


def plain_records(rows: DataFrame) -> DataFrame:
    """Rows without a header as records: file, sheet, record (the row's number from 1), text of '列k: value' lines."""
    names = F.transform("values", lambda _, k: F.concat(F.lit("列"), (k + 1).cast("string")))
    return rows.select(*SHEET, (F.col("index") + 1).alias("record"), _lines(names, F.col("values")).alias("text"))


def sheet_texts(cells: DataFrame) -> DataFrame:
    """Each sheet as one text, by its orientation and header: file, sheet, orientation, text.

    Cells, rows and headers are read by several parts, so each is written once."""
    cells = settled(filled(cells))
    known = settled(orientation(cells))
    flat = settled(sheet_rows(cells).join(known.where(F.col("orientation") == ROWS).select(*SHEET), SHEET, "left_semi"))
    tops = settled(header_rows(flat))
    headed = flat.join(tops.select(*SHEET), SHEET, "left_semi")
    numbered = lambda d, head: d.select(*SHEET, F.lit(3).alias("part"), F.col("record").alias("k"), F.concat(*head, "text").alias("line"))
    record = [F.lit("记录"), F.col("record").cast("string"), F.lit("：\n")]
    matrix = known.where(F.col("orientation") == MATRIX).select(*SHEET)
    before = headed.join(tops.withColumnRenamed("index", "top"), SHEET).where("index < top")
    parts = [
        matrix.select(*SHEET, F.lit(0).alias("part"), F.lit(0).alias("k"), F.lit(MATRIX_MARK).alias("line")),
        numbered(matrix_records(cells).join(matrix, SHEET, "left_semi"), [F.lit("\n【车型记录"), F.col("record").cast("string"), F.lit("】\n")]),
        before.select(*SHEET).distinct().select(*SHEET, F.lit(0).alias("part"), F.lit(0).alias("k"), F.lit(PREFACE_MARK).alias("line")),
        before.select(*SHEET, F.lit(1).alias("part"), F.col("index").alias("k"), F.array_join(F.filter("values", lambda v: v != ""), " | ").alias("line")),
        header_names(headed, tops).join(before.select(*SHEET, F.lit("\n").alias("gap")).distinct(), SHEET, "left").select(*SHEET, F.lit(2).alias("part"), F.lit(0).alias("k"), F.concat(F.coalesce("gap", F.lit("")), F.lit("字段："), F.array_join("names", " | ")).alias("line")),
        numbered(table_records(headed, tops), [F.lit("\n"), *record]),
        numbered(plain_records(flat.join(tops.select(*SHEET), SHEET, "left_anti")), record).withColumn("line", F.concat("line", F.lit("\n"))),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    texts = lines.groupBy(*SHEET).agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "k", "line")))["line"], "\n").alias("text"))
    return known.join(texts, SHEET)
