"""Stages of the corpus pipeline against brute force on small tables."""

from __future__ import annotations

import random

from test_llm_operators import documents, shingle_set, union_find


def near_copies(count=40, length=200):
    """Texts and copies of them whose similarity is from 0.80 to less than 0.85."""
    rng = random.Random(9)
    rows = []
    for n in range(count):
        one = [f"w{rng.randrange(10_000)}" for _ in range(length)]
        other = list(one)
        while (share := len(a & b) / len(a | b) if (a := shingle_set(" ".join(one))) and (b := shingle_set(" ".join(other))) else 0) >= 0.85:
            other[rng.randrange(length)] = f"v{rng.randrange(10_000)}"
        if share >= 0.8:
            rows += [(2 * n, " ".join(one)), (2 * n + 1, " ".join(other))]
    return rows


def test_near_duplicate_stage_links_at_four_fifths(spark):
    import corpus_pipeline

    rows = near_copies()
    assert len(rows) > 60
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    roots = union_find(len(rows), pairs)
    want = {min(rows[j][0] for j in range(len(rows)) if roots[j] == r) for r in roots}
    got = corpus_pipeline.near_duplicates(spark, documents(spark, [*rows, (None, rows[0][1])]), "")
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == sorted(want)
    assert got.where("doc_id is null").count() == 1


CLASH = {c: f"mine {c}" for c in ("row", "_row", "_id", "_key", "key", "_copies", "copies", "copy", "place", "id", "score", "spans", "masked", "lang_pred", "blend", "size", "taken", "component_id", "kept", "b")}


def clashing(spark, rows):
    """Documents whose further columns bear the names that stages and operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()})


def sentences(rng, n=40):
    words = {"en": "the of and house river with under bright morning water people", "de": "der die und haus fluss mit unter heller morgen wasser leute", "fr": "le la et maison fleuve avec sous matin clair eau gens"}
    return [(i, " ".join(rng.choice(words[lang].split()) for _ in range(60)), lang, f"s{i % 2}") for i in range(n) for lang in [rng.choice(sorted(words))]]


def test_stages_keep_columns_of_clashing_names(spark):
    import corpus_pipeline

    rows = [*sentences(random.Random(1)), (900, None, None, None), (901, "", "en", "s0"), (None, "the house under the river " * 9, "en", None), (902, "12 34 !!", "en", "s1"), (903, "write to ann@host.org now, the house and the river", "en", "s0")]
    docs = clashing(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    got = {}
    for name in ("language", "near_duplicates", "personal_data", "mixing"):
        out = stages[name](spark, docs, "")
        assert out.columns == docs.columns
        got[name] = out.collect()
        assert all(r[c] == v for r in got[name] for c, v in CLASH.items())
    # Language: what holds no letter goes, clean documents stay.
    assert sorted(str(r["doc_id"]) for r in got["language"]) == sorted(str(r[0]) for r in rows if r[0] not in (900, 901, 902))
    # Personal data: only the text with an item changes, and its length with it.
    by_id = {r["doc_id"]: r for r in got["personal_data"]}
    assert len(got["personal_data"]) == len(rows) and by_id[903]["text"] == "write to <email> now, the house and the river"
    assert by_id[903]["n_chars"] == len(by_id[903]["text"]) and by_id[900]["text"] is None and by_id[901]["text"] == ""
    assert all(by_id[r[0]]["text"] == r[1] for r in rows if r[0] != 903)
    # Near duplicates: nothing here is alike, so all stay.
    assert len(got["near_duplicates"]) == len(rows)
    # Mixing: every copy is a whole row, at most twice; texts without words take no part.
    count = {}
    for r in got["mixing"]:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert set(count.values()) <= {1, 2} and not {900, 901} & set(count)
    words = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in ("s0", "s1")}
    for s, target in (("s0", min(2, 1.5 * sum(words.values()) / words["s0"] * 5 / 8)), ("s1", 0.5)):
        share = sum(len(r["text"].split()) for r in got["mixing"] if r["source"] == s) / words[s]
        assert share >= min(target, 1) * 0.6


def test_rows_of_one_id_leave_one(spark):
    import corpus_pipeline

    rows = [(1, "b text of its own kind here", "en", "s"), (1, "a text of quite another kind there", "en", "s"), (1, None, "en", "s"), (2, "something else that is alone here", "en", "s")]
    got = corpus_pipeline.near_duplicates(spark, clashing(spark, rows), "")
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, rows[1][1]), (2, rows[3][1])]
