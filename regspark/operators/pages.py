"""Page extraction (X1-X9) over a table of landed pages.

A page is one row, its markup text or the bytes as they came. A native test tells flat pages: well-formed
tables of one head and one body whose cells hold text alone (``FLAT``, one pass of possessive patterns). Their
tables, rows and cells are cut out, and labels looked up, by built-in functions. All other pages (nested tables, missing
end tags, odd quoting, entities, scripts) go to a small parser in an Arrow-batched function, for which
flat pages are NULL. It reads each byte once, also of damaged markup: what is not ended (a comment, script, tag
or quoted value) runs to the end of the page. The parser counts as non-deterministic, so that no filter on its results
is moved below it, which would read every page again for each mention of them. A page that cannot be read (bytes that are no UTF-8, tables
nested deeper than ``MAX_NESTED``) becomes an error record and leaves the other pages alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from regspark.functions.ids import GSTIN_LENGTH
from regspark.functions.text import join_codes, stamp
from regspark.operators.results import NO_RECORDS

# --- fixed values -----------------------------------------------------------
# Classes of the search-results table on the registry page.
RESULT_TABLE_CLASSES = ("table", "tbl", "inv", "exp", "table-bordered", "ng-table")
GENERIC_TABLE_CLASSES = ("table",)
ERR_NO_TABLE = "Error: Results table not found"
ERR_NO_ROWS = "Error: No results extracted"
ERR_PAGE = "Error: "
LABEL_TRADE_NAME = "Trade Name"
LABEL_REG_DATE = "Date of Registration"
LABEL_HSN = "HSN"
LABEL_EFFECTIVE_DATE = "Effective Date of registration"
# ---------------------------------------------------------------------------

# Page structure rules of HTML that a raw page may leave implicit (fixed values).
VOID_TAGS = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
SECTIONS = frozenset(("tbody", "thead", "tfoot"))
CELLS = frozenset(("td", "th"))
ENDS_PARAGRAPH = frozenset(("p", "div", "table", "ul", "ol", "section", "h1", "h2", "h3", "h4", "h5", "h6"))

BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())  # what ``str.strip()`` drops
MAX_NESTED = 16  # tables open at once; a row counts for each table around it, so work grows with the depth

TEXTS = ArrayType(StringType())
TABLE_TYPE = StructType().add("classes", TEXTS).add("headers", TEXTS).add("rows", ArrayType(TEXTS))
TABLES_TYPE = StructType().add("tables", ArrayType(TABLE_TYPE)).add("error", StringType())
FIELDS_TYPE = (StructType().add("trade_name", StringType()).add("registration_date", StringType())
               .add("hsn_codes", TEXTS).add("error", StringType()))


# -- flat pages: built-in functions -----------------------------------------------------------

# Each loop is possessive, so a page is passed once whether it fits or not.
_TEXT = r"(?:[^<&\xa0]++|&(?:amp|lt|gt|quot);)*+"
_ATTRS = r"""(?:\s++[a-z-]++="[^"<>&]*+")*+"""
_CELLS = rf"(?:<td{_ATTRS}>{_TEXT}</td>\s*+)*+"
_HEAD = rf"(?:<thead>\s*+<tr{_ATTRS}>\s*+(?:<th{_ATTRS}>{_TEXT}</th>\s*+)*+</tr>\s*+</thead>\s*+)?+"
_TABLE = (rf"""<table(?: class="[ !#-%'-;=?-~]*+")?+>\s*+{_HEAD}<tbody>\s*+(?:<tr{_ATTRS}>\s*+{_CELLS}</tr>\s*+)*+"""
          r"</tbody>\s*+</table>")
_OTHER = rf"</?+(?!(?:table|tbody|thead|tfoot|tr|td|th|script|style%s)\b)[a-z][a-z0-9]*+{_ATTRS}\s*+/?+>"
_CARD = rf"<div{_ATTRS}>\s*+(?:<(h6|p){_ATTRS}>{_TEXT}</\1>\s*+)*+</div>"
FLAT = rf"(?s)\A(?:[^<&\xa0]++|&(?:amp|lt|gt|quot);|{_TABLE}|{_OTHER % ''})*+\z"
FLAT_ALT = rf"(?s)\A(?:[^<&\xa0]++|&(?:amp|lt|gt|quot);|{_TABLE}|{_CARD}|{_OTHER % '|h6|p'})*+\z"


def _decoded(c: Column) -> Column:
    """A flat page's text as it shows: its four entities decoded, outer white space dropped."""
    whole = c
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        whole = F.replace(whole, F.lit(entity), F.lit(char))
    return F.btrim(F.when(c.contains("&"), whole).otherwise(c), F.lit(BLANKS))


def _pieces(c: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(rf"<{tag}(?:\s[^>]*+)?+>([^<]*+)</{tag}>"), F.lit(1)), _decoded)


def _flat_tables(html: Column) -> Column:
    """``_tables`` of a flat page."""
    def table(t):
        css = F.regexp_extract(t, r'\A<table(?: class="([^"]*+)")?', 1)
        rows = F.regexp_extract_all(F.substring_index(t, "<tbody>", -1), F.lit(r"(?s)<tr[^>]*+>(.*?)</tr>"), F.lit(1))
        return F.struct(F.filter(F.split(css, " +"), lambda c: c != "").alias("classes"),
                        _pieces(t, "th").alias("headers"), F.transform(rows, lambda r: _pieces(r, "td")).alias("rows"))

    return F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<table[^>]*+>.*?</table>"), F.lit(0)), table)


# A table of the class "table" with a header cell that holds the code label.
_CODED = rf"""\A<table class="(?=[^"]*?table)[^"]*+">\s*+<thead>\s*+<tr[^>]*+>\s*+(?:<th[^>]*+>(?![^<]*?{LABEL_HSN})[^<]*+</th>\s*+)*+<th[^>]*+>[^<]*?{LABEL_HSN}"""


def _labelled(label: str) -> str:
    """A body cell of a flat page whose text holds ``label``, which is free of entities and thus found undecoded;
    a cell is passed once, however often it holds the label."""
    return rf"<td[^>]*+>(?>[^<]*?{label})[^<]*+</td>"


def _first_beside(html: Column, label: str) -> Column:
    """The cell after the first labelled one that is not its row's last; '' if there is none."""
    return _decoded(F.regexp_extract(html, rf"{_labelled(label)}\s*+<td[^>]*+>([^<]*+)</td>", 1))


def _all_beside(html: Column, label: str) -> Column:
    """The cells after the first one of their row that holds ``label``: the one beside it, then on from the last match."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?:\G(?!\A)|{_labelled(label)})\s*+<td[^>]*+>([^<]*+)</td>"), F.lit(1)), _decoded)


def _flat_fields(html: Column) -> Column:
    """``_fields`` of a flat page. Labels are looked up in the page itself; tables are cut out only where no label is."""
    def codes(beside):
        coded = F.filter(F.regexp_extract_all(html, F.lit(r"(?s)<table[^>]*+>.*?</table>"), F.lit(0)), lambda t: t.rlike(_CODED))
        firsts = F.regexp_extract_all(F.substring_index(F.coalesce(F.get(coded, 0), F.lit("")), "<tbody>", -1),
                                      F.lit(r"<tr[^>]*+>\s*+<td[^>]*+>([^<]*+)</td>"), F.lit(1))
        return F.when(F.size(beside) > 0, beside).otherwise(F.transform(firsts, _decoded))

    return F.struct(_first_beside(html, LABEL_TRADE_NAME).alias("trade_name"), _first_beside(html, LABEL_REG_DATE).alias("registration_date"),
                    F.transform(F.array(_all_beside(html, LABEL_HSN)), codes)[0].alias("hsn_codes"),  # the cells are found once
                    F.lit(None).cast("string").alias("error"))


def _flat_fields_alt(html: Column) -> Column:
    """``_fields_alt`` of a flat page."""
    def first(label):
        return _decoded(F.regexp_extract(html, rf"<h6{_ATTRS}>[^<]*?{label}[^<]*+</h6>\s*+(?:<h6{_ATTRS}>[^<]*+</h6>\s*+)*+<p{_ATTRS}>([^<]*+)</p>", 1))

    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*+>(.*?)</tr>"), F.lit(1))
    firsts = F.transform(rows, lambda r: _decoded(F.regexp_extract(r, r"<td[^>]*+>([^<]*+)</td>", 1)))
    return F.struct(first(LABEL_TRADE_NAME).alias("trade_name"), first(LABEL_EFFECTIVE_DATE).alias("registration_date"),
                    F.filter(firsts, lambda c: c != "").alias("hsn_codes"), F.lit(None).cast("string").alias("error"))


# -- other pages: a parser --------------------------------------------------------------------

# A tag with its name and attributes (values quoted after "=" may hold ">"), a declaration, or text.
TOKEN = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[^>=]++|=)*+)(?:>|\Z)"""
                   r"""|<[!?][^>]*+(?:>|\Z)|([^<]++|<)""")
CLASS = re.compile(r"""(?i)(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
UNSEEN = {tag: re.compile(rf"(?i)</{tag}\s*+>") for tag in ("script", "style")}


class PageTree:
    """One page's elements and texts in document order: element ``i`` spans
    ``i + 1 .. end[i] - 1``. Adds what a browser adds: a missing ``tbody``, and the
    ends of cells, rows, sections and paragraphs."""

    def __init__(self, html: str):
        self.parent, self.end = [], []
        self.at: dict = {}  # elements by tag
        self.text_at, self.text_data = [], []
        self.first_text: dict = {}  # of an element
        self.css: dict = {}  # class text of the tables
        self.in_body, self.in_head = set(), set()  # rows of a tbody, header cells of a thead
        self._open, self._depths = [], {}  # (element, tag) from the outermost; depths at which a tag is open
        pos, size = 0, len(html)
        while pos < size:
            if html.startswith("<!--", pos):
                stop = html.find("-->", pos + 4)
                pos = size if stop < 0 else stop + 3
                continue
            m = TOKEN.match(html, pos)
            pos = m.end()
            closing, name, attrs, data = m.groups()
            if data:
                self._text(unescape(data) if "&" in data else data)
            elif name:
                tag = name.lower()
                if closing:
                    self._ends(tag)
                elif tag in UNSEEN:
                    stop = UNSEEN[tag].search(html, pos)
                    pos = stop.end() if stop else size
                else:
                    self._starts(tag, attrs)
        self._leave(0)

    def _add(self):
        self.parent.append(self._open[-1][0] if self._open else -1)
        self.end.append(len(self.parent))
        return len(self.parent) - 1

    def _text(self, data):
        i = self._add()
        self.text_at.append(i)
        self.text_data.append(data)
        self.first_text.setdefault(self.parent[i], data)

    def _enter(self, tag):
        i = self._add()
        self.at.setdefault(tag, []).append(i)
        if tag not in VOID_TAGS:
            self._depths.setdefault(tag, []).append(len(self._open))
            self._open.append((i, tag))
        return i

    def _leave(self, depth):
        for i, tag in reversed(self._open[depth:]):
            self.end[i] = len(self.parent)
            self._depths[tag].pop()
        del self._open[depth:]

    def _innermost(self, tags):
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=-1)

    def _shut(self, tags, inside):
        """End the innermost open element of ``tags``, unless one of ``inside`` is nearer."""
        depth = self._innermost(tags)
        if depth > self._innermost(inside):
            self._leave(depth)

    def _starts(self, tag, attrs):
        if tag in CELLS:
            self._shut(CELLS, ("tr", "table"))
        elif tag == "tr":
            self._shut(("tr",), ("table",))
            if self._open and self._open[-1][1] == "table":
                self._enter("tbody")
        elif tag in SECTIONS:
            self._shut(SECTIONS, ("table",))
        elif tag in ENDS_PARAGRAPH:
            self._shut(("p",), ("td", "th", "table"))
        i = self._enter(tag)
        if tag == "tr" and self._depths.get("tbody"):
            self.in_body.add(i)
        elif tag == "th" and self._depths.get("thead"):
            self.in_head.add(i)
        elif tag == "table":
            m = CLASS.search(attrs)
            self.css[i] = unescape(m[1] or m[2] or m[3] or "") if m else ""
            if len(self._depths["table"]) > MAX_NESTED:
                raise ValueError(f"tables are nested deeper than {MAX_NESTED}")

    def _ends(self, tag):
        if tag == "table":
            self._shut((tag,), ())
        else:
            self._shut((tag,), ("table",) if tag == "tr" or tag in CELLS or tag in SECTIONS else ("td", "th", "table"))

    def every(self, tag):
        return self.at.get(tag, [])

    def inside(self, i, tag):
        every = self.every(tag)
        return every[bisect_left(every, i + 1):bisect_left(every, self.end[i])]

    def text(self, i):
        """Visible text, entities decoded, non-breaking blanks as blanks, stripped."""
        own = self.text_data[bisect_left(self.text_at, i + 1):bisect_left(self.text_at, self.end[i])]
        return "".join(own).replace("\xa0", " ").strip()

    def labelled(self, tag, label):
        """Elements whose first own text holds ``label`` (its case counts)."""
        return [i for i in self.every(tag) if label in self.first_text.get(i, "")]

    def values(self, tag, label, value_tag):
        """``value_tag`` siblings after the labelled elements, in document order."""
        first = {}
        for i in self.labelled(tag, label):
            first.setdefault(self.parent[i], i)
        return [self.text(j) for j in self.every(value_tag) if j > first.get(self.parent[j], j)]


def _tables(html: str) -> dict:
    t = PageTree(html)
    return {"tables": [{"classes": t.css[i].split(),
                        "headers": [t.text(h) for h in t.inside(i, "th") if h in t.in_head],
                        "rows": [[t.text(c) for c in t.inside(r, "td")] for r in t.inside(i, "tr") if r in t.in_body]}
                       for i in t.every("table")]}


def _fields(html: str) -> dict:
    t = PageTree(html)
    codes = t.values("td", LABEL_HSN, "td")
    if not codes:  # the first column of the first table with an HSN header, header row skipped
        heads = set(t.labelled("th", LABEL_HSN))
        table = next((i for i in t.every("table") if "table" in t.css[i]
                      and any(h in heads for h in t.inside(i, "th"))), None)
        rows = [] if table is None else [t.inside(r, "td") for r in t.inside(table, "tr")[1:]]
        codes = [t.text(r[0]) for r in rows if r]
    return {"trade_name": next(iter(t.values("td", LABEL_TRADE_NAME, "td")), ""),
            "registration_date": next(iter(t.values("td", LABEL_REG_DATE, "td")), ""), "hsn_codes": codes}


def _fields_alt(html: str) -> dict:
    t = PageTree(html)
    tables, firsts = set(t.in_body), {}
    for c in t.every("td"):
        if t.parent[c] in tables:
            firsts.setdefault(t.parent[c], c)
    inner = {r for i in t.every("table") for r in t.inside(i, "tr")}
    return {"trade_name": next(iter(t.values("h6", LABEL_TRADE_NAME, "p")), ""),
            "registration_date": next(iter(t.values("h6", LABEL_EFFECTIVE_DATE, "p")), ""),
            "hsn_codes": [t.text(c) for r, c in firsts.items() if r in inner]}


def read_page(read, html: str | bytes | None) -> dict | None:
    """What ``read`` finds in a page, or its failure as ``error`` (X9); NULL stays NULL."""
    if html is None:
        return None
    try:
        return read(html if isinstance(html, str) else html.decode())
    except Exception as e:  # noqa: BLE001 - one page's failure is its own record
        return {"error": str(e)}


def _parser(read, returns: DataType):
    arrow_type = to_arrow_type(returns)

    @F.arrow_udf(returns)
    def parse(html: pa.Array) -> pa.Array:
        return pa.array([read_page(read, h) for h in html.to_pylist()], type=arrow_type)

    return parse.asNondeterministic()


parse_tables = _parser(_tables, TABLES_TYPE)            # every table: classes, header cells, body rows
parse_fields = _parser(_fields, FIELDS_TYPE)            # details, label and value cells
parse_fields_alt = _parser(_fields_alt, FIELDS_TYPE)    # details, headings and paragraphs


def _read_pages(pages: DataFrame, keys, html: str, flat: str, native, parse) -> DataFrame:
    """(keys, _nr: the page says 'No records found', _p): flat pages (also NULL ones, read as empty) by ``native``, the
    others by ``parse``. Flat pages are read first, so only what they hold waits beside the parser, not their markup."""
    given, text = F.col(html), F.col(html).cast("string")
    fits = F.coalesce(text.rlike(flat), F.lit(True))
    if isinstance(pages.schema[html].dataType, BinaryType):
        fits = fits & F.coalesce(F.is_valid_utf8(text), F.lit(True))
    told = pages.select(*keys, given.alias("_given"), F.coalesce(text, F.lit("")).alias("_html"), fits.alias("_flat"))
    read = told.select(*keys, F.col("_html").contains(NO_RECORDS).alias("_nr"), F.when(F.col("_flat"), native(F.col("_html"))).alias("_native"),
                       F.when(~F.col("_flat"), F.col("_given")).alias("_other"))
    # both uses of ``_native`` keep its projection a step of its own, below the parser
    return read.select(*keys, "_nr", F.when(F.col("_native").isNotNull(), F.col("_native")).otherwise(parse("_other")).alias("_p"))


def _with_classes(tables, classes) -> Column:
    wanted = F.array(*[F.lit(c) for c in classes])
    return F.filter(tables, lambda t: F.size(F.array_except(wanted, t["classes"])) == 0)


def chosen_tables(pages: DataFrame, keys, html: str) -> DataFrame:
    """Per page ``_tables``, those with the result-table classes; if there are none, any ``table``-class table."""
    def native(h):
        return F.struct(_flat_tables(h).alias("tables"), F.lit(None).cast("string").alias("error"))

    parsed = _read_pages(pages, keys, html, FLAT, native, parse_tables).select(
        *keys, "_nr", "_p.error", F.coalesce("_p.tables", F.array()).alias("_all"))
    specific = parsed.withColumn("_specific", _with_classes(F.col("_all"), RESULT_TABLE_CLASSES))
    return specific.select(*keys, "_nr", F.col("error").alias("_error"), F.when(F.size("_specific") > 0, F.col("_specific"))
                           .otherwise(_with_classes(F.col("_all"), GENERIC_TABLE_CLASSES)).alias("_tables"))


def parse_result_pages(pages: DataFrame, keys=("pan", "page_no"), html: str = "html") -> DataFrame:
    """Each page parsed once: ``_outcome`` (X2: 'No records found' is tested first, then a failure of the page) and
    ``_rows`` (X1 + X3: rows with at least four cells; shorter ones, such as footers, are skipped)."""
    rows = F.filter(F.flatten(F.transform("_tables", lambda t: t["rows"])), lambda r: F.size(r) >= 4)
    found = chosen_tables(pages, keys, html).select(*keys, "_nr", "_error", F.size("_tables").alias("_nt"), rows.alias("_rows"))
    outcome = (F.when(F.col("_nr"), F.lit(NO_RECORDS))
               .when(F.col("_error").isNotNull(), F.concat(F.lit(ERR_PAGE), F.col("_error")))
               .when(F.col("_nt") == 0, F.lit(ERR_NO_TABLE))
               .when(F.size("_rows") == 0, F.lit(ERR_NO_ROWS)))
    return found.select(*keys, outcome.alias("_outcome"), "_rows")


def extract_result_rows(pages: DataFrame, keys=("pan", "page_no"), html: str = "html") -> DataFrame:
    """X1 + X3 + X5: one row per result row: serial, GSTIN, status, state (cells 1-4)
    and ``bad_length`` (kept, only flagged, when the GSTIN is not 15 characters)."""
    k = list(keys)
    parsed = parse_result_pages(pages, k, html)
    rows = F.posexplode_outer(F.when(F.col("_outcome").isNull(), F.col("_rows"))).alias("row_no", "_c")
    return parsed.select(*k, rows).where(F.col("row_no").isNotNull()).select(
        *k, F.col("row_no").cast("long").alias("row_no"),
        F.col("_c")[0].alias("serial"), F.col("_c")[1].alias("gstin"),
        F.col("_c")[2].alias("gstin_status"), F.col("_c")[3].alias("state"),
        (F.length(F.col("_c")[1]) != GSTIN_LENGTH).alias("bad_length"))


def page_outcomes(pages: DataFrame, keys=("pan", "page_no"), html: str = "html") -> DataFrame:
    """X2 per page, with the number of usable rows."""
    parsed = parse_result_pages(pages, keys, html)
    return parsed.select(*keys, F.col("_outcome").alias("outcome"),
                         F.when(F.col("_outcome").isNull(), F.size("_rows")).otherwise(F.lit(0))
                         .cast("long").alias("n_rows"))


def page_results(pages: DataFrame, keys=("pan", "page_no"), html: str = "html") -> DataFrame:
    """Q5, first half: pages back to result items; a page with an outcome yields one
    item carrying that text, as the original lookup recorded it."""
    parsed = parse_result_pages(pages, keys, html)
    null = F.lit(None).cast("string")
    item = lambda r: F.struct(r[0].alias("serial"), r[1].alias("gstin"), r[2].alias("gstin_status"),
                              r[3].alias("state"), null.alias("result"))
    fail = F.array(F.struct(null.alias("serial"), null.alias("gstin"), null.alias("gstin_status"),
                            null.alias("state"), F.col("_outcome").alias("result")))
    items = F.when(F.col("_outcome").isNull(), F.transform("_rows", item)).otherwise(fail)
    return parsed.select(*keys, F.posexplode_outer(items).alias("item_no", "_i")).select(  # never empty
        *keys, F.col("item_no").cast("long").alias("item_no"), "_i.*")


def item_order() -> Column:
    """Page and item number in one whole number, which a hash aggregate can hold."""
    return F.shiftleft(F.col("page_no"), 32) + F.col("item_no")


def landed_items(items: DataFrame, as_of) -> DataFrame:
    """Q5's items as landed lookup results: ``ord`` is page and item number in one, ``seen_at`` the run time."""
    return items.select("pan", item_order().alias("ord"),
                        "gstin", "gstin_status", "state", "result", stamp(as_of).alias("seen_at"))


def table_headers(pages: DataFrame, keys=("pan", "page_no"), html: str = "html") -> DataFrame:
    """Header cell texts (``thead th``) of each selected table."""
    heads = F.transform("_tables", lambda t: t["headers"])
    return chosen_tables(pages, keys, html).select(*keys, F.posexplode(heads).alias("table_no", "headers")).withColumn(
        "table_no", F.col("table_no").cast("long"))


def _without_blanks(codes: Column) -> Column:
    return F.filter(codes, lambda x: x != "")


def extract_details(pages: DataFrame, key: str = "gstin", html: str = "html") -> DataFrame:
    """X6 + X7 + X9: name, registration date, codes (blanks dropped, distinct, first order
    kept); ``error`` for pages saying 'No records found' and for pages that cannot be read (their fields are NULL)."""
    parsed = _read_pages(pages, [key], html, FLAT, _flat_fields, parse_fields).select(
        key, F.when(F.col("_nr"), F.lit(NO_RECORDS)).otherwise(F.col("_p.error")).alias("error"),
        F.col("_p").alias("_f"))
    ok = F.col("error").isNull()
    return parsed.select(
        key,
        F.when(ok, F.col("_f.trade_name")).alias("trade_name"),
        F.when(ok, F.col("_f.registration_date")).alias("registration_date"),
        F.when(ok, F.array_distinct(_without_blanks(F.col("_f.hsn_codes")))).alias("hsn_codes"),
        "error")


def extract_details_alt(pages: DataFrame, keys=("gstin", "page_no"), html: str = "html") -> DataFrame:
    """The second source's layout: heading and a paragraph beside it for name and effective
    date, first cell of every table body row as a code, repeats kept, blanks dropped; ``error`` as in X9."""
    parsed = _read_pages(pages, keys, html, FLAT_ALT, _flat_fields_alt, parse_fields_alt)
    return parsed.select(*keys, "_p.trade_name", "_p.registration_date",
                         _without_blanks(F.col("_p.hsn_codes")).alias("hsn_codes"), "_p.error")


def details_with_text(details: DataFrame) -> DataFrame:
    """The stored form: codes as ", "-joined text."""
    return details.withColumn("hsn_codes", join_codes("hsn_codes"))
