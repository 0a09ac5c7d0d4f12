import re

import duckdb
import pytest

from iterix.llm import quality_rules as Q
from iterix.session import ship

SCHEMA = "doc_id long, text string, source string, n_words string"


def brute(rows, cfg=Q.RulesConfig()):
    """The operator's definition, in plain loops."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    key = lambda line: "".join(split(line)).lower()
    hosts, seen = {}, {}
    for doc, text, host, _ in rows:
        if doc is not None:
            hosts.setdefault(host, set()).add(doc)
            for line in (text or "").split("\n"):
                if key(line):
                    seen.setdefault((host, key(line)), set()).add(doc)
    out = []
    for doc, text, host, _ in rows:
        text = text or ""
        words, lines = split(text), [x for x in text.split("\n") if split(x)]
        at = {}
        for i in range(len(words) - 4):
            at.setdefault(tuple(words[i : i + 5]), []).append(i)
        covered = {j for found in at.values() if len(found) > 1 for i in found for j in range(i, i + 5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        over = lambda n: n > cfg.min_docs and n * 1000 > len(hosts.get(host, ())) * cfg.host_permille
        removed = sum(len(split(x)) for x in lines if over(len(seen.get((host, key(x)), ()))))
        kept = not failed and removed * 100 <= len(words) * cfg.depleted_percent
        out.append((doc, len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), failed, removed, kept))
    return out


def rows_of():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()
    unique = lambda k: " ".join(f"{w}{k}" for w in words)
    rows = [(k, f"{unique(k)}\nAll rights  reserved here\n\n{unique(k + 100)}", "a", "z") for k in range(14)]
    rows += [(20 + k, f"{unique(k)} x\nSubscribe to our very long shared news letter today because it is really great and more of it follows each and every week", "a", None) for k in range(12)]
    rows += [(50, None, "a", None), (51, "", None, None), (52, "one two", None, None), (53, " \n\t\n", "b", None), (None, unique(1), "a", None), (None, "all rightsreserved here " + unique(2), None, None)]
    rows += [(54, "a b c d e f " * 5, "b", None), (55, "x\ny\nx\nX\n x\n" + unique(5), "b", None), (56, "é#日$ %\x0b&|<> " + unique(3) + "\r\n" + unique(4), "b", None), (57, "w " * 20000, "b", None)]
    return rows + [rows[0], rows[0], rows[-2], (0, "another text of document zero " + unique(9), "a", None)]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_against_brute_force(spark):
    rows = rows_of()
    got = Q.quality_rules(ship(spark).createDataFrame(rows, SCHEMA))
    want = brute(rows)
    assert any(r[7] for r in want) and any(not r[6] and not r[8] for r in want)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_sql_agrees(spark):
    rows = [r for r in rows_of() if r[0] is not None]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar, n_words varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
    sql = con.execute(f"select {', '.join(names)} from ({Q.SQL})").fetchall()
    assert sorted(sql, key=key) == sorted(brute(rows), key=key)


def test_empty_table_and_native_plan(spark):
    out = Q.quality_rules(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("min_docs,kept", [(2, False), (3, True)])
def test_limit_is_exclusive(spark, min_docs, kept):
    line = "the same long line in each of these documents of one host"
    df = ship(spark).createDataFrame([(k, line, "h", None) for k in range(3)], SCHEMA)
    assert {r.kept for r in Q.quality_rules(df, Q.RulesConfig(min_docs=min_docs)).collect()} == {kept}


def test_cleaned_texts_are_the_rest(spark):
    """Every row's text less the lines over its host's limit, in place; the columns of the query follow from it."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    key_of = lambda line: "".join(split(line)).lower()
    first = rows_of()[0]
    rows = rows_of() + [(*first[:2], "other", None), (70, "\n\nALL RIGHTS reservedhere\r\n \nits own line\n", "a", None), (71, "All rights reserved here", "a", None)]
    hosts, seen = {}, {}
    for doc, text, host, _ in rows:
        if doc is not None:
            hosts.setdefault(host, set()).add(doc)
            for line in (text or "").split("\n"):
                if key_of(line):
                    seen.setdefault((host, key_of(line)), set()).add(doc)
    want = []
    for doc, text, host, _ in rows:
        lines = text.split("\n") if text is not None else []
        n = lambda x: len(seen.get((host, key_of(x)), ()))  # noqa: B023, E731
        at = [k for k, x in enumerate(lines) if n(x) > 10 and n(x) * 1000 > len(hosts[host]) * 5]
        want.append((doc, host, None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in at), at, sum(len(split(lines[k])) for k in at)))
    got = Q.cleaned(ship(spark).createDataFrame(rows, SCHEMA)).collect()
    flat = lambda rows: sorted(rows, key=repr)
    assert flat((r.doc_id, r.source, r.clean_text, [x.pos for x in r.removed], r.removed_words) for r in got) == flat(want)
    assert (70, "a", "\n\n \nits own line\n", [2], 3) in want and (71, "a", "", [0], 4) in want
    assert all(r.removed_words == len(split(r.text or "")) - len(split(r.clean_text or "")) for r in got)
