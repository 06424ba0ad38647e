"""Text formats as DataFrame expressions: series CSV, factor CSV with a preamble, nested facts, columnar JSON, wide bars,
wiki tables, change lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_csv(lines: DataFrame, series: str, description: str = "", revised: bool = False) -> DataFrame:
    """Lines (value) "date,number" of one series: a dot is a null value, a line without a date is left out."""
    part = F.split("value", ",")
    out = lines.select(F.lit(series).alias("series_id"), F.try_to_date(F.trim(F.get(part, F.lit(0))), "yyyy-MM-dd").alias("date"), F.nullif(F.trim(F.get(part, F.lit(1))), F.lit(".")).try_cast("double").alias("value"))
    return out.where("date IS NOT NULL").withColumns({"description": F.lit(description), "revised": F.lit(revised)})


def factor_csv(lines: DataFrame, names: list[str]) -> DataFrame:
    """Lines (n, value) with a preamble and a trailer around rows "yyyymmdd,percent,...": the rows from the first eight-digit
    date to the next line that has none; -99 and less is null, percent becomes a fraction."""
    part = F.split("value", ",")
    is_row = F.col("value").rlike(r"^\s*\d{8}\s*,")
    x = lines.withColumn("r", is_row)
    first = x.where("r").agg(F.min("n").alias("a"))
    stop = x.crossJoin(F.broadcast(first)).where("NOT r AND n > a").agg(F.min("n").alias("z"))
    body = x.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(stop)).where("r AND n >= a AND (z IS NULL OR n < z)")
    value = lambda i: F.trim(F.get(part, F.lit(i))).try_cast("double")
    return body.select(F.to_date(F.trim(F.get(part, F.lit(0))), "yyyyMMdd").alias("date"), *[F.when(value(i + 1) > -99, value(i + 1) / 100).alias(c) for i, c in enumerate(names)])


OBS = "struct<start:string,end:string,val:double,fy:int,fp:string,form:string,filed:string,accn:string,frame:string>"
FACTS = f"struct<entityName:string,facts:map<string,map<string,struct<units:map<string,array<{OBS}>>>>>>"


def flatten_facts(payloads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Payloads (cik, json) of facts by taxonomy, tag and unit as rows, a row an observation; without a filing date it is
    left out. Restated periods come as often as they were filed."""
    x = payloads.select("cik", F.from_json("json", FACTS).alias("p"))
    x = x.select("cik", F.col("p.entityName").alias("entity_name"), F.explode("p.facts").alias("taxonomy", "tags")).select("*", F.explode("tags").alias("tag", "t"))
    if keep is not None:
        x = x.where(F.col("tag").isin(keep))
    x = x.select("cik", "entity_name", "taxonomy", "tag", F.explode("t.units").alias("unit", "obs")).select("*", F.explode("obs").alias("o"))
    return x.where("o.filed IS NOT NULL").select(
        "cik", "entity_name", "taxonomy", "tag", "unit", F.col("o.start").alias("period_start"), F.col("o.end").alias("period_end"), F.col("o.val").alias("value"),
        F.col("o.fy").alias("fy"), F.col("o.fp").alias("fp"), F.col("o.form").alias("form"), F.col("o.filed").alias("filed_date"), F.col("o.accn").alias("accession"), F.col("o.frame").alias("frame"),
    )


def build_facts(flat: DataFrame) -> DataFrame:
    """Facts without repeats on their keys."""
    return flat.dropDuplicates(["cik", "taxonomy", "tag", "unit", "period_start", "period_end", "filed_date", "accession"])


def restated_once(facts: DataFrame) -> DataFrame:
    """Facts that were filed on more than one date."""
    return facts.groupBy("cik", "tag", "unit", "period_start", "period_end").agg(F.countDistinct("filed_date").alias("filings")).where("filings > 1")


def columnar_json(payloads: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Payloads (json) of {fields, data}: rows with the named fields, cast."""
    x = payloads.select(F.from_json("json", "struct<fields:array<string>,data:array<array<string>>>").alias("p")).select("p.fields", F.explode("p.data").alias("row"))
    return x.select(*[F.get("row", F.array_position("fields", F.lit(k)).cast("int") - 1).try_cast(v).alias(k) for k, v in fields.items()])


def wide_to_long(wide: DataFrame, date: str = "date", sep: str = "|") -> DataFrame:
    """Columns "field|ticker" as rows (ticker, date, field columns); rows without any value are padding and go."""
    columns = [c for c in wide.columns if c != date]
    fields = sorted({c.split(sep)[0] for c in columns})
    tickers = sorted({c.split(sep)[1] for c in columns})
    rows = [F.struct(F.lit(t).alias("ticker"), *[(F.col(f"`{f}{sep}{t}`").cast("double") if f"{f}{sep}{t}" in columns else F.lit(None).cast("double")).alias(f.lower()) for f in fields]) for t in tickers]
    out = wide.select(F.col(date).cast("date").alias("date"), F.explode(F.array(*rows)).alias("r")).select("date", "r.*")
    return out.where(F.coalesce(*[F.col(f.lower()) for f in fields]).isNotNull())


def wiki_ticker(cell: Column) -> Column:
    """The ticker in a table cell: of an exchange template, of a link, or bare; what is no ticker is null."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(cell, r"\{\{\s*(?:NYSE|NASDAQ|NyseSymbol|NasdaqSymbol|BZX link)[^|}]*\|\s*([A-Za-z.\-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(cell, r"\[\[(?:[^|\]]*\|)?\s*([A-Z.\-]{1,6})\s*\]\]", 1), F.lit("")),
        F.nullif(F.regexp_extract(cell, r"\[\S+\s+([A-Z.\-]{1,6})\]", 1), F.lit("")),
        F.nullif(F.regexp_extract(F.trim(cell), r"^([A-Z][A-Z.\-]{0,5})$", 1), F.lit("")),
    )
    upper = F.upper(found)
    return F.when(upper.rlike(r"^[A-Z][A-Z.\-]{0,5}$") & ~upper.isin("NYSE", "NASDAQ", "SEC", "USD"), upper)


def wiki_constituents(pages: DataFrame) -> DataFrame:
    """Pages (page, text) of wiki markup: page, ticker of each row of the table that has a column of tickers, once each, in order."""
    rows = pages.select("page", F.posexplode(F.split("text", r"\n\|-[^\n]*")).alias("n", "row"))
    cells = rows.select("page", "n", F.filter(F.transform(F.split("row", r"\n[|!]|\|\||!!"), lambda c: F.trim(F.regexp_replace(c, r"^\s*[|!]", ""))), lambda c: (c != "") & ~c.startswith("{|")).alias("cells"), F.col("row").contains("!").alias("header"))
    at = F.array_position(F.transform("cells", lambda c: c.rlike("(?i)^(ticker|symbol)")), F.lit(True)).cast("int")
    head = cells.where("header").withColumn("at", at).where("at > 0").groupBy("page").agg(F.min_by("at", "n").alias("at"))
    named = cells.join(head, "page").where("NOT header").select("page", "n", wiki_ticker(F.get("cells", F.col("at") - 1)).alias("ticker"))
    return named.where("ticker IS NOT NULL").groupBy("page", "ticker").agg(F.min("n").alias("n")).orderBy("page", "n").select("page", "ticker")


def change_events(rows: DataFrame) -> DataFrame:
    """Change lists (date, added, removed, reason) as text: dates of several forms, footnote marks gone, rows with neither
    ticker left out, once each."""
    text = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\[\w+\]", "")), F.lit(""))
    d = text(F.col("date"))
    day = F.coalesce(*[F.try_to_date(d, f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy")])
    out = rows.select(day.alias("effective_date"), text(F.col("added")).alias("added_ticker"), text(F.col("removed")).alias("removed_ticker"), text(F.col("reason")).alias("reason"))
    return out.where("effective_date IS NOT NULL AND (added_ticker IS NOT NULL OR removed_ticker IS NOT NULL)").dropDuplicates(["effective_date", "added_ticker", "removed_ticker"])


def series_gate(bars: DataFrame, intervals: DataFrame, most_bad: int = 5, most_move: float = 4.0, least_cover: float = 0.5) -> DataFrame:
    """Per ticker: impossible rows, largest move on a day without a split, and span over membership; with a verdict."""
    w = Window.partitionBy("ticker").orderBy("date")
    bad = (F.col("high") < F.col("low")) | (F.least("open", "high", "low", "close") <= 0)
    move = F.when(F.coalesce(F.col("split_ratio"), F.lit(0.0)).isin(0.0, 1.0), F.abs(F.col("close") / F.lag("close").over(w) - 1))
    b = bars.withColumns({"bad": bad, "move": move}).groupBy("ticker").agg(F.count_if("bad").alias("bad_rows"), F.max("move").alias("max_move"), F.min("date").alias("a"), F.max("date").alias("z"))
    iv = intervals.groupBy("ticker").agg(F.min("start_date").alias("s"), F.max(F.coalesce("end_date", F.current_date())).alias("e"))
    over = F.datediff(F.least("z", "e"), F.greatest("a", "s")) / F.greatest(F.datediff("e", "s"), F.lit(1))
    x = b.join(iv, "ticker", "left").withColumn("cover", F.greatest(over, F.lit(0.0)))
    reject = (F.col("bad_rows") > most_bad) | (F.col("max_move") > most_move) | (F.coalesce("cover", F.lit(1.0)) < least_cover)
    return x.select("ticker", "bad_rows", "max_move", "cover", F.coalesce(reject, F.lit(False)).alias("rejected"))


def carry_forward(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones of keys that the new do not have."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))
