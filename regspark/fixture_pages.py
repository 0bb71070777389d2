"""Landed pages and nested records derived from the fixtures (FIXTURES.md section 4).

The original tool read pages from a live site; here pages are rendered by
Spark from the fixture tables so that extraction can be checked against the
rows they were made from. Every page is built from a bounded group: result
pages hold the rows of one PAN within one block of 1000 order keys, detail
pages the distinct codes of one GSTIN, alternative detail pages the code rows
of one GSTIN within one block of 1000 positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.fixtures import fixture, landed
from regspark.operators.enrich import details_table

# --- fixed values -----------------------------------------------------------
PAGE_BLOCK = 1000
SPECIFIC_TABLE = '<table class="table tbl inv exp table-bordered ng-table">'
GENERIC_TABLE = '<table class="table table-sm">'
RESULT_HEAD = ("<thead><tr><th>S.No</th><th>GSTIN/UIN</th><th>GSTIN/UIN Status</th>"
               "<th>State</th></tr></thead>")
DECOY_TABLE = ('<table class="table"><tbody><tr><td>0</td><td>DECOY</td><td>-</td>'
               "<td>-</td></tr></tbody></table>")
HSN_TABLE = '<table class="table table-striped"><thead><tr><th>HSN</th><th>Description</th></tr></thead><tbody>'
# ---------------------------------------------------------------------------


def esc(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    c = F.coalesce(c.cast("string"), F.lit(""))
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(ch), F.lit(ent))
    return c


def _td(*cols) -> Column:
    return F.concat(*[F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in cols])


def _ordered_concat(sort_col: str, html_col: str) -> Column:
    """Concatenate the pieces of a (bounded) group in ``sort_col`` order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(sort_col, html_col))),
                                    lambda s: s[html_col]), "")


def _third(key: str) -> Column:
    return F.pmod(F.hash(F.col(key)), F.lit(3)) == 0


def lookup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pan, page_no, html): search-result pages, and outcome pages for PANs without hits."""
    return landed(spark, sf_dir, "lookup_pages", lambda: _lookup_pages(spark, sf_dir))


def _lookup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lr = fixture(spark, sf_dir, "lookup_results")
    hits = lr.where(F.col("gstin").isNotNull()).select(
        "pan", F.floor(F.col("ord") / PAGE_BLOCK).cast("long").alias("page_no"), "ord",
        F.concat(F.lit("<tr>"), _td("ord", "gstin", "gstin_status", "state"), F.lit("</tr>")).alias("tr"))
    grouped = hits.groupBy("pan", "page_no").agg(_ordered_concat("ord", "tr").alias("body"),
                                                F.count(F.lit(1)).alias("n"))
    generic = _third("pan")
    html = F.concat(
        F.lit("<html><body><h3>Search Result</h3>"),
        F.when(generic, F.lit(GENERIC_TABLE)).otherwise(F.lit(SPECIFIC_TABLE)),
        F.lit(RESULT_HEAD), F.lit("<tbody>"), F.col("body"),
        F.lit('<tr><td colspan="3">Total</td><td>'), F.col("n").cast("string"), F.lit("</td></tr>"),
        F.lit("</tbody></table>"),
        F.when(generic, F.lit("")).otherwise(F.lit(DECOY_TABLE)),
        F.lit("</body></html>"))
    result_pages = grouped.select("pan", "page_no", html.alias("html"))
    outcome_pages = lr.where(F.col("result").isNotNull()).select(
        "pan", F.lit(0).cast("long").alias("page_no"),
        F.concat(F.lit('<html><body><div class="alert">'), esc("result"),
                 F.lit("</div></body></html>")).alias("html"))
    return result_pages.unionByName(outcome_pages)


def details_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gstin, trade_name, registration_date, hsn_codes array of distinct codes)."""
    return details_table(fixture(spark, sf_dir, "details"), fixture(spark, sf_dir, "details_hsn"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gstin, html) for every requested 15-character GSTIN; two thirds label/value
    cells, one third an HSN table; unknown GSTINs get a 'No records found' page."""
    return landed(spark, sf_dir, "detail_pages", lambda: _detail_pages(spark, sf_dir))


def _detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fixture(spark, sf_dir, "requested_gstins")
    ids = asked.where(F.length("gstin") == 15).select("gstin").distinct()
    d = ids.join(details_landed(spark, sf_dir).withColumn("_known", F.lit(True)), "gstin", "left")
    codes = F.col("hsn_codes")
    head = F.concat(F.lit('<table class="table"><tbody><tr><td>GSTIN</td><td>'), esc("gstin"),
                    F.lit("</td></tr><tr><td>Trade Name</td><td>"), esc("trade_name"),
                    F.lit("</td></tr><tr><td>Date of Registration</td><td>"), esc("registration_date"),
                    F.lit("</td></tr>"))
    label_rows = F.array_join(F.transform(codes, lambda c: F.concat(
        F.lit("<tr><td>HSN Code</td><td>"), esc(c), F.lit("</td></tr>"))), "")
    # one repeated code and one blank value, which extraction must drop
    extra = F.when(F.size(codes) > 0, F.concat(
        F.lit("<tr><td>HSN Code</td><td>"), esc(F.get(codes, 0)),
        F.lit("</td></tr><tr><td>HSN Code</td><td> </td></tr>"))).otherwise(F.lit(""))
    table_rows = F.array_join(F.transform(codes, lambda c: F.concat(
        F.lit("<tr><td>"), esc(c), F.lit("</td><td>Goods</td></tr>"))), "")
    known = F.when(_third("gstin"),
                   F.concat(head, F.lit("</tbody></table>"), F.lit(HSN_TABLE), table_rows, F.lit("</tbody></table>")))\
        .otherwise(F.concat(head, label_rows, extra, F.lit("</tbody></table>")))
    html = F.when(F.col("_known").isNull(),
                  F.lit('<html><body><div class="alert alert-danger">No records found</div></body></html>'))\
        .otherwise(F.concat(F.lit("<html><body>"), known, F.lit("</body></html>")))
    return d.select("gstin", html.alias("html"))


def detail_pages_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gstin, page_no, html) in the second source's layout, code rows with repeats."""
    return landed(spark, sf_dir, "detail_pages_alt", lambda: _detail_pages_alt(spark, sf_dir))


def _detail_pages_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = fixture(spark, sf_dir, "details_hsn").select(
        "gstin", F.floor(F.col("pos") / PAGE_BLOCK).cast("long").alias("page_no"), "pos",
        F.concat(F.lit("<tr><td>"), esc("hsn_code"), F.lit("</td><td>Goods</td></tr>")).alias("tr"))
    grouped = codes.groupBy("gstin", "page_no").agg(_ordered_concat("pos", "tr").alias("body"))
    d = fixture(spark, sf_dir, "details")
    html = F.concat(
        F.lit('<html><body><div class="card"><h6>Trade Name</h6><p>'), esc("trade_name"),
        F.lit("</p><h6>Effective Date of registration</h6><p>"), esc("registration_date"),
        F.lit("</p></div>"), F.lit(HSN_TABLE), F.col("body"), F.lit("</tbody></table></body></html>"))
    return grouped.join(d, "gstin").select("gstin", "page_no", html.alias("html"))


def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, results map<pan, array<item>>): ``lookup_results`` regrouped the way the
    checkpoint file nests them, one record per PAN and block of 1000 order keys."""
    lr = fixture(spark, sf_dir, "lookup_results")
    items = lr.select("pan", F.floor(F.col("ord") / PAGE_BLOCK).cast("long").alias("chunk"),
                      F.struct("ord", "gstin", "gstin_status", "state", "result").alias("item"))
    grouped = items.groupBy("pan", "chunk").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return grouped.select("chunk", F.create_map("pan", "items").alias("results"))


def pan_gstin_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, pan_gstin_map map<pan, array<gstin>>) of the 15-character GSTINs."""
    lr = fixture(spark, sf_dir, "lookup_results").where(F.length("gstin") == 15)
    items = lr.select("pan", F.floor(F.col("ord") / PAGE_BLOCK).cast("long").alias("chunk"),
                      F.struct("ord", "gstin").alias("g"))
    grouped = items.groupBy("pan", "chunk").agg(
        F.transform(F.array_sort(F.collect_list("g")), lambda s: s["gstin"]).alias("gstins"))
    return grouped.select("chunk", F.create_map("pan", "gstins").alias("pan_gstin_map"))
