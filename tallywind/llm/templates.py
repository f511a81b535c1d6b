"""Main text of web pages by deducing the template of their host.

A page is a sequence of tokens: tags, and the text between two tags as one token. A token's role
is what it says together with the elements it stands in. In three passes over the pages

1. every role of a host gets its occurrence vector over the host's pages, kept as four sums
   (pages, occurrences, and two fingerprints: occurrences times a hash of the page). Roles of
   equal sums form an equivalence class; classes of at least MIN_ROLES roles that occur on at
   least SHARE of a host's pages are candidates;
2. a candidate is valid if on every page its roles come in the same order, round after round,
   and if it nests: of two classes one lies between two neighbouring roles of the other. Of two
   that interleave the one with fewer roles goes. What is left is the host's template;
3. a page is read against its host's template: template tokens are consumed, and what stands in
   the slots between them is text if the elements around a slot are no menu, header, footer,
   sidebar, notice, advert, form or comments; a block is dropped as constant if all of its texts
   are template. If the page marks its article (article, main, or a role
   that says so), only slots in there count; else blocks that are mostly links go, too. On a
   page all of whose text is template (copies of one page) slots alone decide.

A host with fewer than MIN_PAGES different pages has no template; its pages are read by their own
elements. Equal pages of a host count as one page (their weights add up to one).

Sums combine inside tasks, so a host with most of the pages is no group anywhere; a host's
template is at most as long as its pages' common part. Templates and the list of repeated pages are joined, with a
broadcast only where Spark's size threshold allows it.

Defined cases: null html is empty and has no text; a null or unreadable url belongs to the host
null, which is a host like others; pages of any length are read whole; repeated rows give
repeated rows; an empty table gives an empty result. Columns other than page_id, url and html
take no part, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, store

#: Different pages a host needs for a template.
MIN_PAGES = 8
#: Share of a host's pages a class occurs on.
SHARE = 0.9
#: Roles of a class.
MIN_ROLES = 3
#: Weight of a page, shared out among its copies.
WHOLE = 1 << 20
#: Rows a task holds before it hands on what it has summed.
HELD = 50_000

# Elements of HTML and how browsers treat them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption head html legend li dd dt option optgroup summary tbody td tfoot th thead tr".split())
#: A start tag ends an open element of the same group, up to the element that holds the group.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
SILENT = frozenset("script style textarea title xmp iframe noembed noframes head template noscript object svg math canvas audio video "
                   "select option button datalist".split())
ASIDE = frozenset("nav aside footer menu dialog".split())
ROLES_ASIDE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# Words in class and id names that mark what is no main text.
NAMES_ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion popup modal overlay "
    "cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription paywall "
    "nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs pagination pager toc skip "
    "sidebar aside rail widget widgets toolbar related recommended recommendations trending share sharing social "
    "comment comments commentlist disqus respond replies reply discussion "
    "footer foot copyright colophon masthead topbar login signin signup search hidden".split())

_ATTRS = r"(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*+(?:>|\Z)"
_MARKUP = re.compile(
    r"<(?:(?P<comment>!--(?:-?>|.*?(?:--!?>|\Z)))"
    r"|(?P<raw>(?P<rawname>script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>])" + _ATTRS +
    r".*?(?:</(?P=rawname)(?=[\s/>])[^>]*(?:>|\Z)|\Z))"
    r"|(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>" + _ATTRS + r")"
    r"|(?P<bogus>[!?]|/(?=[^a-z]))[^>]*(?:>|\Z))", re.I | re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[a-z]+")
_BLANKS = re.compile(r"\s+")


class _Element:
    __slots__ = ("name", "path", "aside", "form", "main", "silent", "link")

    def __init__(self, name, path, aside, form, main, silent, link):
        self.name, self.path, self.aside, self.form, self.main, self.silent, self.link = name, path, aside, form, main, silent, link


def _names(name: str, attrs: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element's attributes mark it as no main text, or as main text."""
    role = attrs.get("role", "").lower()
    main = role in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
    aside = role in ROLES_ASIDE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" \
        or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    if not aside and name not in ("html", "body", "main"):
        given = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        if name == "article":
            words = set(given.lower().split())
        else:
            words = {w.lower() for w in _WORDS.findall(given)}
        aside = bool(words & NAMES_ASIDE)
    return aside, main


class Token:
    """A tag (``text`` None) or the text between two tags, where it stands, and its role."""

    __slots__ = ("role", "text", "block", "aside", "main", "link")

    def __init__(self, role, text, block, aside, main, link):
        self.role, self.text, self.block, self.aside, self.main, self.link = role, text, block, aside, main, link


def _start_tag(name: str, rest: str, seen: dict) -> tuple[str, bool, bool, bool]:
    """Class names of a start tag, whether it marks no main text or main text, and whether it
    is an element without content. ``seen`` keeps what tags said before."""
    got = seen.get((name, rest))
    if got is None:
        raw = rest.removesuffix(">").rstrip()
        attrs: dict[str, str] = {}
        for k, v in _ATTR.findall(raw):
            attrs.setdefault(k.lower(), html_lib.unescape(v.strip("\"'")) if v else "")
        if len(seen) > 5000:
            seen.clear()
        got = seen[name, rest] = (attrs.get("class", ""), *_names(name, attrs), name in VOID or (raw.endswith("/") and name not in BLOCKS))
    return got


def tokens(page: str, seen: dict | None = None) -> list[Token]:
    """The tokens of a page. Texts of one block share its number; unclosed and misplaced tags
    are read as browsers do for these cases: a block ends an open paragraph, a list item the item before, an end
    tag all elements inside its own, an end tag without a start tag is a block's end only."""
    out: list[Token] = []
    stack = [_Element("", "", False, False, False, False, False)]
    block, at = 0, 0
    seen = {} if seen is None else seen

    def text(upto: int) -> None:
        if upto > at:
            raw = page[at:upto]
            if raw.isspace():
                out.append(Token("", raw, block, True, False, False))
                return
            top = stack[-1]
            out.append(Token(f"{top.path}\0{' '.join(raw.split())}", raw, block,
                             top.aside or top.form or top.silent, top.main, top.link))

    def close(names: tuple[str, ...], upto: tuple[str, ...] = ()) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return True
            if stack[i].name in upto:
                return False
        return False

    for m in _MARKUP.finditer(page):
        text(m.start())
        at = m.end()
        what = m.lastgroup
        if what in ("comment", "bogus"):
            continue
        if what == "raw":
            out.append(Token(f"{stack[-1].path}<{m['rawname'].lower()}>", None, block, True, False, False))
            continue
        name = m["name"].lower()
        is_block = name in BLOCKS
        if m["end"]:
            out.append(Token(f"{stack[-1].path}</{name}>", None, block, True, False, False))
            if is_block:
                block += 1
            close((name,), () if is_block else ("table", "td", "th"))
            continue
        kind, aside, main, empty = _start_tag(name, m["attrs"], seen)
        if is_block:
            block += 1
            if name in CLOSES_P:
                close(("p",), ("table", "td", "th", "li", "article", "section", "div"))
            if name in SIBLINGS:
                inside, holder = SIBLINGS[name]
                while close(inside, holder):
                    pass
        top = stack[-1]
        out.append(Token(f"{top.path}<{name} {kind}>", None, block, True, False, False))
        if name == "br":
            out.append(Token("", " ", block, True, False, False))
        if empty:
            continue
        if is_block or name in SILENT or name == "a" or kind or aside or main:
            main = (main or name in ("article", "main")) and not top.aside and not aside
            stack.append(_Element(
                name, f"{top.path}/{name}" if is_block else top.path,
                top.aside or aside or name in ASIDE or (name == "header" and not top.main),
                False if main else top.form or name == "form", top.main or main, top.silent or name in SILENT, top.link or name == "a"))
    text(len(page))
    return out


def _id(role: str, known: dict[str, int]) -> int:
    """A role's number; those of short roles, tags above all, are kept in ``known``."""
    got = known.get(role)
    if got is None:
        got = int.from_bytes(blake2b(role.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
        if len(role) < 80:
            if len(known) > 20_000:
                known.clear()
            known[role] = got
    return got


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per (host, role) of the pages (host, html, digest, weight) of a task."""
    sums: dict[tuple, list[int]] = {}
    known: dict[str, int] = {}
    tags: dict = {}

    def flush():
        keys, values = list(sums), list(sums.values())
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
             *[pa.array([v[i] for v in values], pa.int64()) for i in range(4)]],
            names=["host", "role", "pages", "times", "print1", "print2"])
        sums.clear()
        return out

    for host, page, digest, weight in _pages(batches):
        one, two = int(digest[:7], 16), int(digest[7:14], 16)
        for role, n in Counter(t.role for t in tokens(page or "", tags) if t.role).items():
            s = sums.setdefault((host, _id(role, known)), [0, 0, 0, 0])
            s[0] += weight
            s[1] += n * weight
            s[2] += n * one
            s[3] += n * two
        if len(sums) > HELD:
            yield flush()
    if sums:
        yield flush()


def _read(classes: str) -> dict[int, tuple[int, int, int]]:
    """Role -> (class, place in its order, roles of its class) of a template in text form."""
    out = {}
    for c, members in enumerate(classes.split(";")):
        roles = [int(r) for r in members.split(",")]
        for i, r in enumerate(roles):
            out[r] = (c, i, len(roles))
    return out


class _Templates:
    """Templates read from their text form, kept while their host's pages come by."""

    def __init__(self):
        self.known: dict[str, dict] = {}

    def __getitem__(self, classes: str | None) -> dict[int, tuple[int, int, int]]:
        if not classes:
            return {}
        got = self.known.get(classes)
        if got is None:
            if len(self.known) > 100:
                self.known.clear()
            got = self.known[classes] = _read(classes)
        return got


def interleaved(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> bool:
    """Whether two classes' (position, place) lists neither follow nor nest: neither has each of
    its rounds whole between two neighbouring tokens of the other."""

    def inside(inner, outer):
        marks = sorted([(p, 0, i) for p, i in outer] + [(p, 1, i) for p, i in inner])
        clear = True  # no outer token since the inner round began
        for _, which, place in marks:
            if which == 0:
                clear = False
            elif place == 0:
                clear = True
            elif not clear:
                return False
        return True

    return not inside(a, b) and not inside(b, a)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Orders of the candidate classes on the pages (host, html, classes) of a task: host,
    class, the class it interleaves with or -1, and its roles in order (empty: in no order)."""
    seen: set[tuple] = set()
    known: dict[str, int] = {}
    tags: dict = {}
    templates = _Templates()

    def flush():
        rows = list(seen)
        out = pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())],
            names=["host", "class", "against", "roles"])
        seen.clear()
        return out

    for host, page, classes in _pages(batches):
        template = templates[classes]
        if not template:
            continue
        found: dict[int, list[tuple[int, int]]] = {}
        for at, t in enumerate(tokens(page or "", tags)):
            if t.role and (r := _id(t.role, known)) in template:
                found.setdefault(template[r][0], []).append((at, r))
        placed: dict[int, list[tuple[int, int]]] = {}
        for c, marks in found.items():
            size = template[marks[0][1]][2]
            order = [r for _, r in marks[:size]]
            fine = len(set(order)) == size and all(marks[i][1] == order[i % size] for i in range(len(marks)))
            seen.add((host, c, -1, ",".join(map(str, order)) if fine else ""))
            if fine:
                placed[c] = [(at, i % size) for i, (at, _) in enumerate(marks)]
        names = sorted(placed)
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                if interleaved(placed[a], placed[b]):
                    small, large = sorted((a, b), key=lambda c: (len({p for _, p in placed[c]}), -c))
                    seen.add((host, small, large, ""))
        if len(seen) > HELD:
            yield flush()
    if seen:
        yield flush()


def main_text(page: str, template: dict[int, tuple[int, int, int]], known: dict[str, int] | None = None,
              tags: dict | None = None) -> str:
    """The text in the slots of a page that are main text."""
    known = {} if known is None else known
    found = tokens(page, tags)
    constant = {id(t) for t in found if t.text is not None and t.role and template and _id(t.role, known) in template}
    texts = [t for t in found if t.text is not None]
    marked = any(t.main and not t.aside for t in texts)

    by: dict[int, list[Token]] = {}
    for t in texts:
        if not t.role or not (t.aside or (marked and not t.main)):
            by.setdefault(t.block, []).append(t)

    def blocks(skip: set[int]) -> list[str]:
        out = []
        for b in sorted(by):
            said = [t for t in by[b] if t.role]
            if not said or all(id(t) in skip for t in said):
                continue
            if not marked and 2 * sum(len(t.text.strip()) for t in said if t.link) > sum(len(t.text.strip()) for t in said):
                continue
            words = _BLANKS.sub(" ", html_lib.unescape("".join(t.text for t in by[b]))).strip()
            if words:
                out.append(words)
        return out

    return "\n".join(blocks(constant) or blocks(set()))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    tags: dict = {}
    templates = _Templates()
    for batch in batches:
        ids, urls, pages, classes = (batch.column(i) for i in range(4))
        texts = [main_text(p or "", templates[c], known, tags) for p, c in zip(pages.to_pylist(), classes.to_pylist())]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """Host of a url in lower case, null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.when(host != "", host)


def _with_templates(rows: DataFrame, templates: DataFrame) -> DataFrame:
    return rows.join(templates.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left")


def deduce(pages: DataFrame) -> DataFrame:
    """Templates of the hosts of ``pages`` (host, html): host and classes, the roles of a class
    in order joined by commas, the classes by semicolons."""
    ship_by_value(__name__)
    rows = pages.select("host", "html", F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"))
    copies = store(rows.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")), "template-pages")
    repeated = store(copies.filter("n > 1").select(F.col("host").alias("of"), F.col("digest").alias("same"), "n"), "template-copies")
    hosts = copies.groupBy("host").agg(F.sum(F.floor(F.lit(WHOLE) / F.col("n")) * F.col("n")).alias("whole"), F.count(F.lit(1)).alias("different"))
    weighed = (rows.join(repeated, F.col("host").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
               .select("host", "html", "digest", F.floor(F.lit(WHOLE) / F.coalesce("n", F.lit(1))).cast("long").alias("weight")))
    sums = weighed.mapInArrow(_count, "host string, role bigint, pages bigint, times bigint, print1 bigint, print2 bigint")
    vectors = store(sums.groupBy("host", "role").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "print1", "print2")]), "template-vectors")
    large = store(hosts.filter(F.col("different") >= MIN_PAGES).withColumnRenamed("host", "of"), "template-hosts")
    classes = (vectors.join(large, F.col("host").eqNullSafe(F.col("of")))
               .filter(F.col("pages") >= F.lit(SHARE) * F.col("whole"))
               .groupBy("host", "pages", "times", "print1", "print2").agg(F.sort_array(F.collect_list("role")).alias("roles"))
               .filter(F.size("roles") >= MIN_ROLES))
    listed = F.concat_ws(";", F.sort_array(F.collect_list(F.concat_ws(",", F.transform("roles", lambda r: r.cast("string"))))))
    candidates = store(classes.groupBy("host").agg(listed.alias("classes")), "template-candidates")

    checked = store(_with_templates(pages.select("host", "html"), candidates).filter("classes is not null").select("host", "html", "classes")
                    .mapInArrow(_check, "host string, class bigint, against bigint, roles string").distinct(), "template-orders")
    ordered = (checked.filter("against < 0").groupBy("host", "class").agg(F.min("roles").alias("roles"), F.max("roles").alias("most"))
               .filter("roles = most and roles <> ''").drop("most"))
    crossed = (checked.filter("against >= 0").select(F.col("host").alias("of"), F.col("class").alias("small"), "against").distinct()
               .join(ordered.select(F.col("host").alias("h"), F.col("class").alias("c")),
                     F.col("of").eqNullSafe(F.col("h")) & (F.col("against") == F.col("c")), "left_semi"))
    valid = ordered.join(crossed, F.col("host").eqNullSafe(F.col("of")) & (F.col("class") == F.col("small")), "left_anti")
    return valid.groupBy("host").agg(F.concat_ws(";", F.transform(F.sort_array(F.collect_list(F.struct("class", "roles"))), lambda c: c["roles"])).alias("classes"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by line breaks) and n_chars of every page."""
    ship_by_value(__name__)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    templates = store(deduce(rows.select("host", "html")), "templates")
    out = (_with_templates(rows, templates).select("page_id", "url", "html", "classes")
           .mapInArrow(_extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


#: The same in DuckDB's SQL for pages as the given tables hold them: the article in its own
#: element, in paragraphs, a heading, bold type and line breaks, nothing else.
SQL = r"""
WITH parts AS (
  SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>')) AS raw,
    generate_subscripts(regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>'), 1) AS nr
  FROM pages),
plain AS (
  SELECT page_id, url, nr, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(replace(raw, '<br>', ' '), '</?b>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS words
  FROM parts),
texts AS (
  SELECT page_id, url, coalesce(string_agg(words, chr(10) ORDER BY nr) FILTER (words <> ''), '') AS text FROM plain GROUP BY page_id, url)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""
