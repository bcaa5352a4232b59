import random
import re
import textwrap
from math import ceil

import pytest

from tessella.llm import license_scan as S


def brute(rows, templates, threshold):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    out = []
    for i, text in rows:
        split = (text or "").split("\n")
        for name, t in templates.items():
            size, found = len(set(words(t))), []
            for lines in range(1, S.RUN + 1):
                for n in range(len(split) - lines + 1):
                    block = words("\n".join(split[n : n + lines]))
                    shared = len(set(block) & set(words(t)))
                    if shared >= ceil(threshold * size - 1e-9) and (lines == 1 or len(block) <= S.SPREAD * size) and not any(n <= a and a + k <= n + lines for a, k in found if k < lines):
                        found.append((n, lines))
                        out.append((i, n, lines, name, shared, shared / size))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_matches_are_those_of_comparing_all(spark, threshold):
    r = random.Random(int(threshold * 10))
    words = [f"w{i}" for i in range(14)]
    templates = {f"t{k}": " ".join(r.sample(words, r.randrange(1, 9))) for k in range(8)}
    rows = [(i, "\n".join(" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 12]))) for _ in range(r.randrange(9)))) for i in range(150)]
    got = S.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates, threshold).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, templates, threshold))


def test_hard_cases(spark, hard_docs, no_docs):
    notice = S.TEMPLATES["apache-2.0"]
    rows = spark.createDataFrame([(70, f"x\n{notice}\n\n{notice.upper()} y"), (None, notice), (71, notice.replace(" ", "\n")), (70, f"x\n{notice}\n\n{notice.upper()} y")], "doc_id bigint, text string")
    got = sorted(((x.doc_id, x.line, x.lines) for x in S.scan(hard_docs.select("doc_id", "text").union(rows)).collect()), key=str)
    assert got == sorted([(70, 1, 1), (70, 3, 1), (70, 1, 1), (70, 3, 1), (None, 0, 1)], key=str)
    assert S.scan(hard_docs).count() == 0 and S.scan(no_docs).count() == 0
    with pytest.raises(ValueError):
        S.scan(no_docs, {"empty": "..."})


@pytest.mark.parametrize("name", ["mit", "bsd", "gpl-later", "apache-2.0-copy", "cc0-1.0", "lgpl"])
@pytest.mark.parametrize("prefix", ["", " * ", "// "])
def test_wrapped_notices_are_found(spark, name, prefix):
    lines = [prefix + x for x in textwrap.wrap(S.TEMPLATES[name], 72)]
    assert len(lines) > 1
    text = "\n".join(["int main() {", "/*", *lines, "*/", "some code that follows"])
    got = [(x.line, x.lines) for x in S.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).where(f"license = '{name}'").collect()]
    assert got and all(a >= 2 and a + n <= 2 + len(lines) for a, n in got)


def test_rows_are_those_of_the_sql(spark, sf_dir, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet' where doc_id % 4 = 0 union all select 10000 + row_number() over (), x, 'en', 's', 0 from (values ('{chr(10).join(textwrap.wrap(S.TEMPLATES['mit'], 60))}'), ('x' || chr(10) || chr(10) || 'y')) v(x)")
    con.execute(f"copy (select doc_id, text from documents) to '{tmp_path}/d.parquet'")
    want = con.execute(S.scan_sql()).fetchall()
    assert sorted(want) == sorted(map(tuple, S.scan(spark.read.parquet(f"{tmp_path}/d.parquet")).collect())) and any(w[2] > 1 for w in want)
