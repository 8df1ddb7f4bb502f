import hashlib
from collections import Counter, defaultdict

import duckdb

from tesserae.llm import line_dedup, quality_rules
from tests.llm import util

WHITE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(WHITE).translate(LOW)


def lines_brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


LINE = "This very line is in many of the documents."


def line_rows():
    texts = util.odd_texts() + [f"{util.prose(9, k)}\n  {LINE.upper() if k % 2 else LINE}\t\nshort\n{LINE}" for k in range(8)] + [LINE, LINE, "éÉ " * 10 + "\n" + LINE, "only twice, this line here\nx", "only twice, this line here"]
    return list(enumerate(texts))


def test_op4_against_brute_force_and_sql(spark, tmp_path):
    rows = line_rows()
    df = util.docs(spark, [t for _, t in rows])
    sf = util.write(spark, tmp_path, documents=util.clash(df))
    got = sorted(tuple(r)[:4] for r in line_dedup.op4_line_dedup(spark, sf).collect())
    assert got == lines_brute(rows)
    documents = df.toPandas()  # noqa: F841
    assert sorted(duckdb.sql(line_dedup.OP4_SQL).fetchall()) == got


def test_runs_compact_and_know_what_is_fresh(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    batch = lambda ids: spark.createDataFrame([(i, k, k) for i, k in ids], "id long, h1 long, h2 long")
    fresh = []
    for b in ([(1, 10), (1, 11)], [(2, 10), (2, 12)], [(3, 12)], [(4, 13), (4, 10)]):
        fresh.append(store.ingest(batch(b)).count())
        store.compact()
    assert fresh == [2, 1, 0, 1]
    assert [len(x) for x in store.levels] == [0, 0, 1]
    total = {r.h1: (r.n_docs, r.max_id) for r in store.total().collect()}
    assert total == {10: (3, 4), 11: (1, 1), 12: (2, 3), 13: (1, 4)}


def test_the_anti_join_decides(spark, monkeypatch):
    """Without what the anti-join hands on, keys that come up after the first batch are never dropped; if it lets all through, keys repeat."""
    texts = [f"the first shared line of part {k % 8}" for k in range(48)]
    df = util.docs(spark, texts)
    assert sum(r.n_dropped for r in line_dedup.dedup_lines(df, batches=6).collect()) == 40
    batch = lambda ids: spark.createDataFrame([(i, k, k) for i, k in ids], "id long, h1 long, h2 long")
    with monkeypatch.context() as m:
        m.setattr(line_dedup.LineRuns, "absent", lambda self, entries, known: entries)
        store = line_dedup.LineRuns(spark)
        store.ingest(batch([(1, 10)]))
        store.ingest(batch([(2, 10)]))
        assert store.total().count() == 2
    monkeypatch.setattr(line_dedup.LineRuns, "absent", lambda self, entries, known: entries.limit(0))
    assert sum(r.n_dropped for r in line_dedup.dedup_lines(df, batches=6).collect()) < 40


def test_many_dropped_lines_in_one_text(spark):
    lines = [f"line number {k} of a very long text" for k in range(30000)]
    texts = ["\n".join(lines), "\n".join(lines[:20000]), "\n".join(lines[10000:])]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(util.docs(spark, texts)).collect()}
    assert got == {0: (30000, 10000), 1: (20000, 10000), 2: (20000, 0)}


def test_line_dedup_of_nothing_and_repeated_ids(spark):
    assert line_dedup.dedup_lines(util.docs(spark, [])).count() == 0
    df = util.docs(spark, [LINE, LINE + "\nb", LINE, LINE], ids=[1, 1, 2, None])
    out = sorted(((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()), key=str)
    # documents 1, 2 and null hold it; 2 is the largest id
    assert out == sorted([(1, "", 1), (1, "b", 1), (2, LINE, 0), (None, "", 1)], key=str)


def counts_brute(text):
    w = [x for x in (text or "").translate(str.maketrans({c: " " for c in WHITE})).split(" ") if x]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    ls = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(cover), n < 50 or 100 * len(cover) > 50 * n)


def test_op5_against_brute_force_and_sql(spark, tmp_path):
    boiler = "This boilerplate line closes each of the pages of the host. " + util.prose(60, 99)
    texts = util.odd_texts() + [util.prose(70 + k, k) + "\n" + boiler for k in range(40)] + [util.prose(12, k) + "\n" + util.prose(9, 100 + k) + "\n" + boiler for k in range(40, 44)]
    texts += ["a b c " * 60, "# * | a b\n# * | a b\n" * 3, util.prose(200, 5) + "\n" + util.prose(200, 5)]
    sources = [None if k % 11 == 0 else "host" for k in range(len(texts))]
    df = util.docs(spark, texts, sources)
    sf = util.write(spark, tmp_path, documents=util.clash(df))
    rows = quality_rules.op5_quality_rules(spark, sf).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts_brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    documents = df.toPandas()  # noqa: F841
    con = duckdb.sql(quality_rules.OP5_SQL)
    names = con.columns
    expected = sorted(tuple(r) for r in con.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in rows) == expected
    depleted = [r.doc_id for r in rows if not r.base_failed and not r.kept]
    assert depleted and all(boiler in texts[i] for i in depleted)


def verdict_brute(rows, limit=quality_rules.MAX_DOCUMENTS):
    """rows of (id, host, text), ids differ: (lost words, lost lines, kept) of each; a document is its id."""
    white = str.maketrans({c: " " for c in WHITE})
    norm = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    n_words = lambda x: len([w for w in x.translate(white).split(" ") if w])
    holders = {}
    for i, host, text in rows:
        for line in {norm(x) for x in (text or "").split("\n")}:
            if len(line) >= 20:
                holders.setdefault((host, line), set()).add(i)
    out = {}
    for i, host, text in rows:
        gone = [x for x in (text or "").split("\n") if len(h := holders.get((host, norm(x)), ())) > limit and i != min(h)]
        lost, n = sum(map(n_words, gone)), n_words(text or "")
        failed = counts_brute(text)[-1]
        out[i] = (lost, len(gone), not failed and n - lost >= 0.3 * n and n - lost >= 50)
    return out


def test_verdict_against_brute_force_by_id(spark):
    boiler = ["Shared line number one of the host, long enough.", util.prose(60, 7), "  Shared LINE number three, with white space  "]
    texts, sources = [], []
    for k in range(120):
        lines = [util.prose(20 + 3 * (k % 30), 1000 + k)] + boiler[: k % 4] + (["short one"] if k % 3 else [])
        texts.append("\n".join(lines) if k % 17 else None)
        sources.append(["a", "b", None][k % 3] if k % 5 else "a")
    texts += [util.prose(60, 5)] * 30  # copies are documents too: the first keeps its line
    sources += ["copies"] * 30
    got = {r.id: (r.lost_words, len(r.lost or []), r.kept) for r in quality_rules.judge(util.docs(spark, texts, sources)).collect()}
    expected = verdict_brute(list(zip(range(len(texts)), sources, texts)))
    assert got == expected
    assert sum(kept for _, _, kept in list(got.values())[120:]) == 1


def test_pages_that_share_one_long_line(spark):
    """500 different documents of one host whose only long line is the same: it is found, and taken from all but the first."""
    boiler = "This notice stands at the end of every page of this host."
    texts = ["\n".join([*(f"row {k} {j}" for j in range(30)), boiler]) for k in range(500)]
    df = util.docs(spark, texts)
    (found,) = quality_rules.frequent_lines(df).collect()
    assert (bytes(found.digest), found.documents, found.holder) == (hashlib.md5(boiler.lower().encode()).digest(), 500, 0)
    kept = {r.doc_id: r.text for r in quality_rules.keep_good(df).collect()}
    assert len(kept) == 500 and kept[0] == texts[0]
    assert all(kept[k] == texts[k].rsplit("\n", 1)[0] for k in range(1, 500))


def test_repeated_windows_beyond_packed_positions(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 4)
    texts = [util.prose(60, 1) + " " + util.prose(20, 1), "a b c d " * 4, util.prose(90, 3)]
    for r in quality_rules.judge(util.docs(spark, texts)).collect():
        assert r.n_repeat_words == counts_brute(texts[r.id])[4]


def test_quality_rules_keep_columns(spark):
    df = util.clash(util.docs(spark, util.odd_texts()))
    out = quality_rules.keep_good(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [4, 5, 6]
    assert quality_rules.keep_good(df.where("doc_id < 0")).count() == 0
