import pytest

from lamina.llm import licenses


def brute(rows, templates):
    out = {}
    for g in licenses.compile_templates(templates):
        for name, text in rows:
            words = licenses.words_of(text or "")
            s = [" ".join(words[i : i + g.width]) for i in range(len(words) - g.width + 1)]
            for a in range(0, len(s), g.stride):
                part = s[a : a + g.window]
                for t in g.templates:
                    share = len(set(part) & set(t.shingles)) / len(t.shingles)
                    if share >= licenses.CONTAINMENT:
                        first = a + next(i for i, x in enumerate(part) if x in t.shingles)
                        key, best = (name, t.number), (share, -first)
                        out[key] = max(out.get(key, best), best)
    return sorted(((n, t, share, -first) for (n, t), (share, first) in out.items()), key=str)


def run(spark, docs, templates=licenses.TEMPLATES):
    return sorted(((r[0], r.template, r.containment, r.first_word) for r in licenses.scan(docs, templates).collect()), key=str)


def test_against_brute_force(spark):
    texts = [None, "", "one", "Released under the MIT License.", "released\nUNDER the mit-license", "Released under the MIT", "All rights reserved", "all rights were reserved"]
    for _, t in licenses.TEMPLATES:
        words = t.split()
        texts += [f"ß é {t} tail " * 2, "x " * 37 + t, " ".join(words[:-1]), " ".join([*words[: len(words) // 2], "odd", *words[len(words) // 2 :]]), " ".join(w for i, w in enumerate(words) if i != 1)]
    texts.append("word " * 50_000 + licenses.TEMPLATES[2][1])
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[3]), (None, texts[6])]
    docs = spark.createDataFrame([(i, 0, t) for i, t in rows], "doc_id long, template int, text string")
    assert run(spark, docs) == brute(rows, licenses.TEMPLATES)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "All rights reserved")], "doc_id long, text string")
    assert run(spark, docs.limit(0)) == [] and run(spark, docs, []) == [] and run(spark, docs, [("none", " . ")]) == []


@pytest.mark.parametrize("g", licenses.compile_templates(licenses.TEMPLATES), ids=lambda g: f"{g.width}x{g.window}")
def test_bands_guarantee_retrieval(g):
    for t in g.templates:
        j = t.needed / (g.window + len(t.shingles) - t.needed)
        assert (1 - j**g.rows) ** g.bands <= licenses.MISS and len(t.shingles) + g.stride - 1 <= g.window


def test_full_texts_use_bands_of_two_rows():
    geometries = licenses.compile_templates(licenses.TEMPLATES)
    wide = [g for g in geometries if g.rows == 2]
    assert {t.name for g in wide for t in g.templates} >= {"MIT", "ISC", "BSD-2-Clause", "Zlib", "Unlicense", "Apache-2.0", "GPL-3.0-or-later"}
    assert all(g.bands > 5 and g.window > 15 for g in wide)


def test_key_words_cover_every_pivot():
    geometries = licenses.compile_templates(licenses.TEMPLATES)
    words = licenses.key_words(geometries)
    assert len(words) < 30 and all(any(w in p for w in words) for g in geometries for t in g.templates for p in t.pivots)
    assert all(len(set(t.pivots)) == len(t.shingles) - t.needed + 1 and set(t.pivots) <= set(t.shingles) for g in geometries for t in g.templates)


def test_query_against_sql(spark, sf_dir):
    import duckdb

    from lamina.llm.queries import op7_licenses

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, op7_licenses(spark, sf_dir).collect())) == sorted(db.execute(licenses.oracle()).fetchall())
    assert "Python" not in op7_licenses(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
