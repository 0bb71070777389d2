"""X1-X9 on hand-written pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.operators import pages as pg

SPEC = '<table class="ng-table table tbl inv exp table-bordered">'
HEAD = "<thead><tr><th>S.No</th><th>GSTIN</th><th>Status</th><th>State</th></tr></thead>"


def _pages(spark, rows):
    return spark.createDataFrame(rows, "pan string, page_no long, html string")


def test_result_rows_specific_table_first(spark):
    html = (f"<html>{SPEC}{HEAD}<tbody><tr><td>1</td><td> 27ABCDE1234F1Z5 </td><td>Active</td>"
            "<td>Tamil &amp; Nadu</td></tr><tr><td colspan=3>Total</td><td>1</td></tr>"
            "<tr><td>2</td><td><b>27ABCDE1234F1Z</b></td><td>Cancelled</td><td>KA</td></tr></tbody></table>"
            '<table class="table"><tbody><tr><td>9</td><td>DECOY</td><td>x</td><td>y</td></tr></tbody></table></html>')
    rows = [tuple(r) for r in pg.extract_result_rows(_pages(spark, [("P", 0, html)])).collect()]
    assert rows == [("P", 0, 0, "1", "27ABCDE1234F1Z5", "Active", "Tamil & Nadu", False),
                    ("P", 0, 1, "2", "27ABCDE1234F1Z", "Cancelled", "KA", True)]


def test_generic_fallback_and_outcomes(spark):
    generic = ('<table class="table x"><tbody><tr><td>1</td><td>G</td><td>S</td><td>T</td></tr></tbody></table>'
               '<table class="other"><tbody><tr><td>1</td><td>NO</td><td>S</td><td>T</td></tr></tbody></table>')
    pages = _pages(spark, [
        ("A", 0, generic),
        ("B", 0, "<div>No records found</div>" + generic),
        ("C", 0, "<p>Error: Results table not found</p>"),
        ("D", 0, f"{SPEC}<tbody><tr><td>1</td><td>2</td></tr></tbody></table>"),
    ])
    out = {r["pan"]: (r["outcome"], r["n_rows"]) for r in pg.page_outcomes(pages).collect()}
    assert out == {"A": (None, 1), "B": ("No records found", 0), "C": (pg.ERR_NO_TABLE, 0), "D": (pg.ERR_NO_ROWS, 0)}
    items = {(r["pan"], r["item_no"]): (r["gstin"], r["result"]) for r in pg.page_results(pages).collect()}
    assert items == {("A", 0): ("G", None), ("B", 0): (None, "No records found"), ("C", 0): (None, pg.ERR_NO_TABLE),
                     ("D", 0): (None, pg.ERR_NO_ROWS)}
    heads = pg.table_headers(_pages(spark, [("P", 0, f"{SPEC}{HEAD}<tbody></tbody></table>")])).first()
    assert heads["headers"] == ["S.No", "GSTIN", "Status", "State"]


def test_details_label_layout(spark):
    html = ('<table class="table"><tr><td>Trade Name</td><td> ACME &amp; Co </td></tr>'
            "<tr><td>Date of Registration</td><td>01/07/2017</td></tr>"
            "<tr><td>HSN Code</td><td>1234</td><td>5678</td></tr><tr><td>HSN</td><td>1234</td></tr>"
            "<tr><td>HSN</td><td> </td></tr></table>")
    d = spark.createDataFrame([("G", html), ("H", "<b>No records found</b>")], "gstin string, html string")
    out = {r["gstin"]: tuple(r)[1:] for r in pg.extract_details(d).collect()}
    assert out["G"] == ("ACME & Co", "01/07/2017", ["1234", "5678"], None)
    assert out["H"] == (None, None, None, "No records found")


def test_details_table_fallback_and_missing(spark):
    html = ('<table class="table"><tr><td>Trade Name</td><td>X</td></tr></table>'
            '<table class="table-striped"><thead><tr><th>HSN Code</th><th>D</th></tr></thead>'
            "<tbody><tr><td>11</td><td>a</td></tr><tr><td>22</td><td>b</td></tr><tr><td>11</td><td>c</td></tr>"
            "</tbody></table>")
    d = spark.createDataFrame([("G", html), ("E", "<p>nothing</p>")], "gstin string, html string")
    out = {r["gstin"]: tuple(r)[1:] for r in pg.extract_details(d).collect()}
    assert out["G"] == ("X", "", ["11", "22"], None)
    assert out["E"] == ("", "", [], None)


def test_details_alt_keeps_repeats(spark):
    html = ("<div><h6>Trade Name</h6><p> Foo </p><h6>Effective Date of registration</h6><p>02/03/2018</p></div>"
            '<table class="table"><thead><tr><th>HSN</th></tr></thead><tbody>'
            "<tr><td>11</td><td>a</td></tr><tr><td>11</td></tr><tr><td> </td></tr><tr><td>22</td></tr></tbody></table>")
    d = spark.createDataFrame([("G", 0, html)], "gstin string, page_no long, html string")
    r = pg.extract_details_alt(d).first()
    assert (r["trade_name"], r["registration_date"], r["hsn_codes"]) == ("Foo", "02/03/2018", ["11", "11", "22"])


def test_raw_page_variants(spark):
    """Nested tables, no tbody, single or no quotes, entities, missing end tags, NULL pages."""
    pages = _pages(spark, [
        ("nested", 0, '<table class="table"><tbody><tr><td>1</td><td>G<table><tr><td>x</td></tr></table></td><td>S</td>'
                      "<td>T</td></tr><tr><td>2</td><td>H</td><td>S</td><td>T</td></tr></tbody></table>"),
        ("raw", 0, "<TABLE class='table x'><tr><td>1<td>J&#38;K &eacute;<td>A&nbsp;B<td>T</table>"),
        ("bare", 0, "<table class=table><thead><tr><th>N</th></tr></thead><tr><td>1</td><td>G</td><td>S</td><td>T</td></tr></table>"),
        ("null", 0, None), ("empty", 0, "")])
    got = sorted((r["pan"], r["row_no"], r["gstin"], r["gstin_status"]) for r in pg.extract_result_rows(pages).collect())
    # the nested cell is a cell of its row too, as in a browser's descendant search
    assert got == [("bare", 0, "G", "S"), ("nested", 0, "Gx", "x"), ("nested", 1, "H", "S"), ("raw", 0, "J&K \xe9", "A B")]
    out = {r["pan"]: r["outcome"] for r in pg.page_outcomes(pages).collect()}
    assert out == {"nested": None, "raw": None, "bare": None, "null": pg.ERR_NO_TABLE, "empty": pg.ERR_NO_TABLE}


def test_labels_are_case_sensitive_and_values_are_siblings(spark):
    det = ("<table><tr><td>trade name history</td><td>OLD</td></tr><tr><td>Trade Name</td><td>NEW</td></tr>"
           "<tr><td><b>Date of Registration</b></td><td>wrapped</td></tr></table>")
    d = spark.createDataFrame([("G", det), ("N", None)], "gstin string, html string")
    out = {r["gstin"]: tuple(r)[1:] for r in pg.extract_details(d).collect()}
    assert out == {"G": ("NEW", "", [], None), "N": ("", "", [], None)}
    alt = ("<div><div><h6>Trade Name</h6></div><div><h6>Effective Date of registration</h6><span>-</span><p>01/02/2018</p></div>"
           "<p>other</p></div>")
    a = spark.createDataFrame([("G", 0, alt)], "gstin string, page_no long, html string")
    r = pg.extract_details_alt(a).first()
    assert (r["trade_name"], r["registration_date"], r["hsn_codes"]) == ("", "01/02/2018", [])


def _text(rng, *parts):
    return "".join(rng.choice(parts) for _ in range(rng.randrange(4)))


def _flat_page(rng):
    """A page of the flat kind (now and then with something that makes it another kind)."""
    words = ("Trade Name", "HSN", "Date of Registration", "Effective Date of registration", " ", "x &amp; y", "&lt;b&gt;", "\n", "\t", "é", "7")
    rare = ("&eacute;", "\xa0", "<b>z</b>", "<!-- c -->", "<br>", "&", "<p>q", "</td>", "<table class='table'><tr><td>1</td></tr></table>")

    def cell(tag):
        attrs = rng.choice(["", "", ' colspan="3"', ' class="a b"', " width=3" if rng.random() < 0.1 else ""])
        odd = rng.choice(rare) if rng.random() < 0.02 else ""
        return f"<{tag}{attrs}>{_text(rng, *words)}{odd}</{tag}>"

    def row(tag, n):
        return "<tr>" + rng.choice(["", "\n "]).join(cell(tag) for _ in range(n)) + "</tr>"

    def table():
        css = rng.choice(["", ' class="table"', ' class="table tbl inv exp table-bordered ng-table"', ' class="table-striped  x"', ' class="other"'])
        head = f"<thead>{row('th', rng.randrange(4))}</thead>" if rng.random() < 0.5 else ""
        return f"<table{css}>{head}<tbody>" + "".join(row("td", rng.randrange(6)) for _ in range(rng.randrange(5))) + "</tbody></table>"

    def card():
        return "<div>" + "".join(f"<{t}>{_text(rng, *words)}</{t}>" for t in (rng.choice(["h6", "p"]) for _ in range(rng.randrange(6)))) + "</div>"

    return "<html><body>" + "".join(rng.choice([table, table, card, lambda: '<div class="alert">hi</div>', lambda: "text "])()
                                    for _ in range(rng.randrange(5))) + "</body></html>"


def test_flat_pages_read_alike_both_ways(spark):
    """Built-in functions and the parser agree on every page that the native test calls flat."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(11)
    html = [_flat_page(rng) for _ in range(1500)] + ["", "plain", "<p>x</p>", "a < b", "<table></table>"]
    df = spark.createDataFrame(list(enumerate(html)), "i int, html string").repartition(4)
    both = df.select("i", F.col("html").rlike(pg.FLAT).alias("flat"), F.col("html").rlike(pg.FLAT_ALT).alias("flat_alt"),
                     pg._flat_tables(F.col("html")).alias("t"), pg._flat_fields(F.col("html")).alias("f"),
                     pg._flat_fields_alt(F.col("html")).alias("a")).collect()
    seen = [0, 0, 0]
    for r in both:
        h = html[r.i]
        if r.flat:
            assert [t.asDict() for t in r.t] == pg._tables(h)["tables"], h
            assert {**r.f.asDict(), "error": 0} == {**pg._fields(h), "error": 0}, h
        if r.flat_alt:
            want = pg._fields_alt(h)
            want["hsn_codes"] = [c for c in want["hsn_codes"] if c]
            assert {**r.a.asDict(), "error": 0} == {**want, "error": 0}, h
        seen = [seen[0] + r.flat, seen[1] + r.flat_alt, seen[2] + (not r.flat)]
    assert seen[0] > 500 and seen[1] > 300 and seen[2] > 50


def test_damaged_megabytes_are_read_in_a_second():
    """Each kind of damage over a megabyte: time grows with the page, not with its square."""
    import time

    n = 1 << 20
    kinds = ["<!--", "<!", "<script>", "<style ", "<td", '<td a="', "<td a='x", "<", "</", "<div>", "</p>", "<p>", "<td>", "<tr>", "&amp",
             "<h6>Trade Name", "<h6>Trade Name</h6><p>v</p>", "<td>HSN</td>", "<tr><td>HSN</td><td>1</td></tr>", "<tbody>", "<thead><th>",
             "<div></span>", "a=", "='", "<a =", "<table></td>"]
    for kind in kinds:
        page = "<table class=table>" + kind * (n // len(kind))
        for read in (pg._tables, pg._fields, pg._fields_alt):
            t0 = time.process_time()
            pg.read_page(read, page)
            assert time.process_time() - t0 < 4, kind  # about a second here; slack for a loaded machine


def test_unended_markup_runs_to_the_end():
    def rows(h):
        return [t["rows"] for t in pg._tables(h)["tables"]]

    good = "<table><tr><td>1</td></tr></table>"
    assert rows(good + "<!-- <table>") == rows(good + "<script>" + good) == rows(good + "<td " + good) == [[["1"]]]
    assert rows("<!-- x -->" + good + '<a title=">" href=\'">\'>' + good) == [[["1"]], [["1"]]]
    assert rows('<table><tr><td ">2</td><td title="a>b">3</td></tr></table>') == [[["2", "3"]]]


def test_broken_pages_become_error_records(spark):
    ok = b'<table class="table"><tbody><tr><td>1</td><td>G</td><td>S</td><td>T</td></tr></tbody></table>'
    deep = b'<table class="table"><tr><td>' * 40
    pages = spark.createDataFrame([("A", 0, ok), ("B", 0, ok + b"\xff\xfe"), ("C", 0, deep), ("D", 0, None),
                                   ("E", 0, b"No records found \xff"), ("F", 0, "<b>é</b>".encode() + ok)],
                                  "pan string, page_no long, html binary")
    out = {r.pan: (r.outcome, r.n_rows) for r in pg.page_outcomes(pages).collect()}
    assert out["A"] == out["F"] == (None, 1) and out["D"] == (pg.ERR_NO_TABLE, 0) and out["E"] == ("No records found", 0)
    assert out["B"][0].startswith("Error: 'utf-8' codec") and out["C"] == ("Error: tables are nested deeper than 16", 0)
    items = {(r.pan, r.gstin, r.result and r.result[:6]) for r in pg.page_results(pages).collect()}
    assert ("B", None, "Error:") in items and ("A", "G", None) in items and len(items) == 6
    details = {r.pan: (r.trade_name, r.error and r.error[:7]) for r in pg.extract_details(pages, "pan").collect()}
    assert details["A"] == ("", None) and details["B"] == (None, "'utf-8'") and details["E"] == (None, "No reco")
    assert {r.pan: r.error is None for r in pg.extract_details_alt(pages, ("pan",)).collect()} == {
        "A": True, "B": False, "C": False, "D": True, "E": False, "F": True}


def test_filters_on_the_results_do_not_read_pages_again(spark):
    """One flat test and one parser a page, whatever is filtered or exploded above them."""
    from regspark.operators import merge

    ok = '<table class="table"><tbody><tr><td>1</td><td>G</td><td>S</td><td>T</td></tr></tbody></table>'
    pages = spark.createDataFrame([("A", 0, ok), ("B", 0, ok + "<p>q"), ("C", 0, "No records found"), ("D", 0, "<p>x</p>"), ("E", 0, None)],
                                  "pan string, page_no long, html string")
    firms = pages.select(F.concat(F.lit("27ABCDE1234F1Z"), "pan").alias("gstin"), "html")
    rows, results = pg.extract_result_rows(pages), pg.page_results(pages)
    found = merge.requested_with_details(firms.select("gstin"), pg.extract_details(firms))
    for df in (rows, results.where(F.col("result").isNull()), found):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count("(?s)<table[^>]*+>.*?</table>") == 1
        assert not [x for x in plan.splitlines() if "ArrowEvalPython" in x and "html" in x]
    assert sorted(r.pan for r in rows.collect()) == ["A", "B"]
    assert sorted((r.pan, r.result) for r in results.collect()) == [
        ("A", None), ("B", None), ("C", pg.NO_RECORDS), ("D", pg.ERR_NO_TABLE), ("E", pg.ERR_NO_TABLE)]
    assert sorted(r.gstin[-1] for r in found.collect()) == ["A", "B", "D", "E"]


def test_labels_are_looked_up_without_cutting_rows_into_cells(spark):
    """Flat pages: as the parser reads them, from the page itself (cutting out every cell took most of a run)."""
    def table(*rows, css="table", head=""):
        return f'<table class="{css}">{head}<tbody>' + "".join(f"<tr>{r}</tr>" for r in rows) + "</tbody></table>"

    coded = "<thead><tr>\n<th>No</th><th width=\"3\">HSN Code</th><th>HSN</th></tr></thead>"
    html = [
        table("<td>x</td><td>HSN</td><td>1</td>\n <td>HSN 2</td><td>3</td>", "<td>HSN</td>", "<td>4</td><td>5</td>", "<td>HSN</td><td>6</td>"),
        table('<td title="HSN">x</td><td>1</td>', "<td>hsn</td><td>2</td>") + "HSN" + table("<td>HSN &amp; more</td><td> &lt;7&gt;&amp;lt; </td>"),
        table("<td>Trade Name</td>", "<td>no</td>", "<td>a</td><td>My Trade Name:</td><td> A &gt; B </td><td>c</td>", "<td>Trade Name</td><td>D</td>"),
        table("<td>Date of Registration</td><td></td>", "<td>Date of Registration</td><td>01/07/2017</td>"),
        table("<td>1</td>", css="other", head=coded) + table("<td>2</td>") + table("<td> 3 </td><td>x</td>", "", "<td>&amp;4</td>", css="x tables", head=coded)
        + table("<td>5</td>", head=coded),
        table(css="table", head=coded) + table("<td>6</td>", head=coded),
        table("<td>7</td>", css="table " * 50, head="<thead><tr>" + "<th>a</th>" * 5000 + "<th>HSN</th></tr></thead>"),
        table("<td>1</td><td>HSN</td>", head=coded), table("<td>" + "HSN" * 200_000 + "</td>"), "HSN Trade Name", "<p>HSN</p><p>1</p>", ""]
    df = spark.createDataFrame(list(enumerate(html)), "i int, html string")
    got = df.select("i", F.col("html").rlike(pg.FLAT).alias("flat"), pg._flat_fields(F.col("html")).alias("f")).collect()
    assert all(r.flat for r in got)
    assert {r.i: {**r.f.asDict(), "error": 0} for r in got} == {i: {**pg._fields(h), "error": 0} for i, h in enumerate(html)}
    codes = {r.i: r.f.hsn_codes for r in got}
    assert codes[0] == ["1", "HSN 2", "3", "6"] and codes[1] == ["<7>&lt;"] and codes[4] == ["3", "&4"] and codes[5] == [] and codes[7] == ["1"]
    plan = pg.extract_details(df, "i")._jdf.queryExecution().optimizedPlan().toString()
    assert "(.*?)</tr>" not in plan and "array_position" not in plan
