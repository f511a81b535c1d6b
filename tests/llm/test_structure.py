"""Templates, periods and Merkle manifests against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib

import pytest

from tallywind.llm import merkle, periods, templates
from tallywind.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- periods

def brute_runs(words, least=12):
    found = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def periodic_words(rng):
    kinds = rng.randint(1, 4)
    out = []
    for _ in range(rng.randint(1, 4)):
        how = rng.random()
        if how < 0.3:
            out += [rng.randrange(kinds) for _ in range(rng.randint(0, 60))]
        elif how < 0.6:
            unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 150))]
            out += (unit * 5)[:rng.randint(len(unit), 5 * len(unit))]
        elif how < 0.8:  # halves that are periodic themselves and meet out of step
            small = [rng.randrange(kinds) for _ in range(rng.randint(1, 3))]
            out += (small * rng.randint(1, 70) + small[:rng.randint(0, 2)]) * rng.randint(1, 3)
        else:
            unit = [rng.randrange(1000) for _ in range(rng.randint(1, 200))]
            out += (unit * 4)[:rng.randint(len(unit), 4 * len(unit))]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = [periodic_words(rng) for _ in range(rng.randint(1, 4))]
        assert periods.runs_of(texts) == [brute_runs(t) for t in texts]


def test_runs_of_structured_words():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a  # Fibonacci words hold as many runs as words get
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    for words in (list(b), thue, ["x"] * 700, (["x", "y"] * 50 + ["x"]) * 4, ["x"] * 11, []):
        assert periods.runs_of([words]) == [brute_runs(words)]


def test_a_long_constant_text_is_one_run():
    words = [b"w"] * 400_000
    assert periods.runs_of([words]) == [[(0, 400_000, 1)]]
    assert periods.kept_words(words, [(0, 400_000, 1)]) == [b"w"]


def test_touching_texts_are_apart():
    unit = [str(i) for i in range(100)]
    assert periods.runs_of([unit, unit, unit]) == [[], [], []]


def test_periods_query_matches_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_periods"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    checked = 0
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 2500:
            continue
        checked += 1
        runs = brute_runs(words)
        drop = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        r = got[doc_id]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()
    assert checked > 150


def test_periods_defined_cases(spark):
    unit = " ".join(f"w{i}" for i in range(30))
    rows = [(None, None, 1), (None, f"{unit} {unit}", 2), (1, "", 3), (1, f"{unit}\n{unit}", 4), (1, f"{unit}\n{unit}", 4),
            (2, "\xa0 x\x1cy " * 3, 5), (3, ("z" * 5000 + " ") * 20, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "n_words")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
                 for r in periods.collapse(docs).collect())
    assert got == sorted([(-1, 0, [], ""), (-1, 60, [(0, 60, 30)], unit), (1, 0, [], ""), (1, 60, [(0, 60, 30)], unit),
                          (1, 60, [(0, 60, 30)], unit), (2, 6, [], "\xa0 x\x1cy \xa0 x\x1cy \xa0 x\x1cy"), (3, 20, [(0, 20, 1)], "z" * 5000)])
    out = periods.digests(periods.collapse(docs.filter("false")))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "n_runs", "start"]


# -- Merkle manifests

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(leaves):
    """Root and, per leaf, the siblings (before, after) from the leaf up."""
    proofs = [[] for _ in leaves]
    level, under = list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, held = [], []
        for at in range(0, len(level), 3):
            run = level[at:at + 3]
            for k in range(len(run)):
                for leaf in under[at + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(sha("".join(run)))
            held.append([leaf for k in range(len(run)) for leaf in under[at + k]])
        level, under = above, held
    return level[0], proofs


def brute_manifest(rows):
    """Counter-like sorted list of (doc_id, leaf, subroot, root, proof)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], brute_leaf(r)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        ordered = sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = (ordered, *brute_tree([leaf for _, leaf in ordered]))
    root, tops = brute_tree([trees[s][1] for s in names])
    return sorted(((d, leaf, trees[s][1], root, p + top) for s, top in zip(names, tops)
                   for (d, leaf), p in zip(trees[s][0], trees[s][2])), key=repr)


def manifest_rows(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in df.collect()), key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1, 1], [2, 3, 4], [5, 9, 10, 28], [730, 1, 81]])
def test_manifest_matches_brute_force(spark, sizes):
    rows = [(i, f"s{k}", "en", i % 7, f"text {i}") for k, n in enumerate(sizes) for i in range(n)]
    assert manifest_rows(merkle.manifest(spark.createDataFrame(rows, DOCS))) == brute_manifest(rows)


def test_blocks_within_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_DIGITS", 2)  # nine leaves a block: four passes for 700 leaves
    rows = [(i, "hot" if i % 7 else f"s{i % 5}", None, i, "x" * (i % 3)) for i in range(820)]
    assert manifest_rows(merkle.manifest(spark.createDataFrame(rows, DOCS))) == brute_manifest(rows)


def test_blocks_a_task_holds_do_not_grow(spark, monkeypatch):
    stored = {}
    keep = merkle.store
    monkeypatch.setattr(merkle, "store", lambda df, label: stored.setdefault(label, []).append(out := keep(df, label)) or out)
    monkeypatch.setattr(merkle, "BLOCK_DIGITS", 2)
    monkeypatch.setattr(merkle, "TASK_BLOCKS", 4)
    rows = [(i, "s", "en", i, "x") for i in range(2000)]
    assert manifest_rows(merkle.manifest(spark.createDataFrame(rows, DOCS))) == brute_manifest(rows)
    files = stored["merkle-blocks"][0].selectExpr("input_file_name() as file").groupBy("file").count().collect()
    assert sum(f["count"] for f in files) == 223 and max(f["count"] for f in files) <= 20
    assert not any("leaves" in df.columns for dfs in stored.values() for df in dfs)


def test_manifest_defined_cases(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, None, "de", None, ""), (5, "é", "de", 1, "ü\n"),
            (5, "é", "de", 1, "ü\n"), (5, "é", "de", 1, "a"), (-3, "z", None, 2, "y" * 300_000), (2, "", "en", 0, "a\nb"), (7, "𐀀", "en", 0, ""),
            (8, "￿", "en", 0, "")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as tree", "2 as hash", "3 as position", "4 as row", "5 as leaf", "6 as item")
    assert manifest_rows(merkle.manifest(docs)) == brute_manifest(rows)
    assert merkle.manifest(docs.filter("false")).count() == 0
    assert merkle.audit(docs.filter("false")).count() == 0


def test_audit_finds_what_was_torn(spark):
    rows = [(i, "a" if i % 3 else None, "en", 1, None if i % 5 == 0 else f"line\n{i}" if i % 2 else "plain") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    proofs = {r[0]: r for r in brute_manifest(rows)}
    for r in merkle.audit(docs).collect():
        row = rows[r["doc_id"]]
        torn = zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None and "\n" in row[4]
        node = brute_leaf((*row[:4], row[4].replace("\n", ""))) if torn else brute_leaf(row)
        proof = proofs[r["doc_id"]][4]
        for before, after in proof:
            node = sha(before + node + after)
        assert r["folded_root"] == node and r["verified"] == (not torn)
        assert r["proof_sha256"] == sha("".join(b + a for b, a in proof))


# -- templates

def brute_main(page):
    """The given pages' article by plain string work."""
    article = re.search(r"<article>(.*?)</article>", page or "", re.S)
    if not article:
        return ""
    import html as H
    blocks = [re.sub(r"\s+", " ", H.unescape(re.sub(r"</?b>", "", b.replace("<br>", " ")))).strip()
              for b in re.split(r"</?(?:p|h1)>", article[1])]
    return "\n".join(b for b in blocks if b)


def test_templates_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["page_id"]: (r["url"], brute_main(r["html"])) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op11_templates"](spark, sf).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def page(body, i=0):
    return (f"<html><head><title>t{i}</title><script>if (a < b) {{ '</p>' }}</script></head><body><div id=top>Our site</div>"
            f"<ul>{''.join(f'<li><a href=/{k}>Go {k} {i}</a></li>' for k in range(3 + i % 4))}</ul>{body}<div>Contact us</div></body></html>")


def test_constant_text_of_a_host_goes_without_an_article_element(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<div><p>Story {i} has <b>its own</b> words &amp; more.</p><p>And so it goes {i * i}.</p></div>", i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} has its own words & more.\nAnd so it goes {i * i}." for i in range(12)}


def test_template_of_a_host(spark):
    rows = [("h", page(f"<div class=x><h1>{i}</h1><p>p{i}</p></div>" + "<i>q</i>" * (i % 3), i)) for i in range(12)]
    rows += [("h", rows[0][1])] * 50 + [("few", page("x"))] * 7
    got = templates.deduce(spark.createDataFrame(rows, "host string, html string")).collect()
    assert [r["host"] for r in got] == ["h"]  # seven equal pages are one page
    classes = sorted(len(c.split(",")) for c in got[0]["classes"].split(";"))
    assert classes[-1] == 17  # the frame, the two constant texts among it
    assert 4 in classes  # the menu's items: li, a and their ends repeat together
    assert sum(classes) <= len({t.role for t in templates.tokens(rows[0][1])})


def test_interleaving_classes():
    inside, outside = [(3, 0), (4, 1), (6, 0), (7, 1)], [(1, 0), (5, 1), (9, 2)]
    assert not templates.interleaved(outside, inside)
    assert templates.interleaved([(1, 0), (4, 1)], [(2, 0), (6, 1)])
    assert not templates.interleaved([(1, 0), (2, 1)], [(3, 0), (4, 1)])


@pytest.mark.parametrize("html, want", [
    ("<p>a &amp b<p>c<br>d", "a & b\nc d"),
    ("<div class=ad>x<p>y</div>z<script>if(a<b){'</p>'}</script> v", "z v"),
    ("a <b>b</b>c&nbsp;&nbsp;d", "a bc d"),
    ("<form><p>Name</p><input name=q></form><p>t</p>", "t"),
    ("<p title='a>b'>t</p><p title=it's>u</p>", "t\nu"),
    ("<article><header><h1>T</h1></header><p>x<aside>s</aside><p>y<ul><li>1<li>2</ul><footer>f</footer></article>"
     "<section class='user-comments'><p>c</section>", "T\nx\ny\n1\n2"),
    ("<p>1 < 2 and <3", "1 < 2 and <3"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<div id=mainMenu><a>x</a></div><div><p>Main <a href=x>link</a> text</p><p><a>only</a></p></div>", "Main link text"),
    ("<header>Site</header><main><p>m</p></main><p>out</p>", "m"),
    ("<div role=banner>b</div><p hidden>h</p><p style='display: none'>n</p><p>t", "t"),
    ("x<!-- unclosed", "x"), ("<p class=\"x", ""), ("</p>a</div>b", "a\nb"), ("", ""), ("<title>only", ""),
])
def test_markup(html, want):
    assert templates.main_text(html, {}) == want


def test_templates_defined_cases(spark):
    long = "word " * 200_000
    body = "<article><p>same words on all of it</p></article>"
    rows = [(None, None, None), (1, "no url", ""), (2, None, f"<article>{long}</article>")]
    rows += [(3, "http://copies.example/x", page(body))] * 30
    rows += [(10 + i, "http://Near.example/x", page(body, i)) for i in range(3)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as classes", "3 as text", "4 as n")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in templates.extract(docs).collect()), key=repr)
    same = "same words on all of it"
    want = [(None, "", 0), (1, "", 0), (2, long.strip(), len(long) - 1)] + [(3, same, len(same))] * 30 + [(10 + i, same, len(same)) for i in range(3)]
    assert got == sorted(want, key=repr)
    assert templates.extract(docs.filter("false")).count() == 0


def test_a_page_that_is_all_template_keeps_its_article(spark):
    body = "<article><p>same words on all of it</p></article>"
    rows = [(i, "http://a.example/x", page(body, i)) for i in range(20)]
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"same words on all of it"} and len(got) == 20
