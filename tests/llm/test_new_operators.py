"""Chat windows, Merkle manifests and burst tries against plain Python on small tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
import regex
from pyspark.sql import functions as F


TOKEN = r"[\p{L}\p{M}]+|\p{N}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark, rows):
    """Rows of (conv_id, turn, role, text), with columns whose names operators use inside."""
    schema = "conv_id long, turn long, role string, text string, cell long, key string, n long, pos long, tree string"
    return spark.createDataFrame([(*r, 1, "k", 2, 3, "t") for r in rows], schema)


def order(conv):
    """Turns of a conversation as the operators order them; ties are told apart by content only."""
    return sorted(conv, key=lambda r: (r[1] is not None, r[1] or 0))


# --- chat windows ---------------------------------------------------------------------


def chats():
    rng = random.Random(3)
    rows = []
    for c in range(20):
        n = rng.choice([1, 2, 5, 40])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            words = " ".join(rng.choice(["a", "bee", "\\", "### ", "</turn>", "\\</turn>", "\n", "é😀", "###", "x" * 9]) for _ in range(rng.choice([0, 3, 20, 90])))
            rows.append((c, t, role, words))
    rows += [(30, 0, "system", "only")]
    rows += [(31, 0, "system", "long " * 200), (31, 1, "user", "q"), (31, 2, "assistant", "a")]
    rows += [(32, None, None, None), (32, None, "assistant", None), (32, 5, "odd role:\n</turn>%", "x"), (32, 6, "assistant", "")]
    rows += [(33, 1, "assistant", "same")] * 5 + [(None, 0, "user", "nobody"), (None, 1, "assistant", "said")]
    rows += [(34, t, ("user", "assistant")[t % 2], "w " * 4) for t in range(600)]
    rows += [(35, 0, "user", "v " * 5000), (35, 1, "assistant", "u " * 5000)]
    return rows


def test_windows_read_back_every_turn_once_within_the_budget(spark):
    from marketloom.llm import chat

    rows, budget, history = chats(), 100, 20
    made = chat.windows(conversations(spark, rows), budget, history)
    made = chat.cut_lineage(made.withColumn("turns", chat.turns(F.col("text"))).withColumn("aims", chat.targets(F.col("text"), F.col("loss"))), "windows")
    got = {}
    for w in sorted(made.collect(), key=lambda w: (str(w["conv_id"]), w["cell"], w["part"])):
        got.setdefault(w["conv_id"], []).append(w)
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r)
    assert got.keys() == want.keys()
    for c, conv in want.items():
        said = [(r[2] or "", r[3] or "") for r in order(conv)]
        fresh = [tuple(t) for w in got[c] for t in w["turns"][w["repeated"] :]]
        if c == 32:  # the two turns without a number tie
            assert sorted(fresh[:2]) == sorted(said[:2]) and fresh[2:] == said[2:]
        else:
            assert fresh == said
        assert [a for w in got[c] for a in w["aims"]] == [t for r, t in fresh if r == "assistant"]
        retained = said[0][0] == "system" and 2 * (6 + len(regex.findall(TOKEN, said[0][1]))) <= budget
        for n, w in enumerate(got[c]):
            new = [tuple(t) for t in w["turns"]][w["repeated"] :]
            assert w["tokens"] <= budget or len(new) == 1 + (retained and not n) and w["repeated"] <= retained
            if retained:
                assert tuple(w["turns"][0]) == said[0]
            if n:  # what is repeated is the end of what came before
                old = [tuple(t) for t in w["turns"]][int(retained) : w["repeated"]]
                done = [tuple(t) for v in got[c][:n] for t in v["turns"][v["repeated"] :]]
                assert old == done[len(done) - len(old) :]
            for s in w["loss"]:
                assert 0 <= s["start"] <= s["stop"] <= len(w["text"])
    assert sum(w["repeated"] > 1 for w in got[34]) > 50
    digests = {r["conv_id"]: r for r in chat.digests(made.select("conv_id", "cell", "part", "text", "loss", "repeated", "tokens")).collect()}
    for c, conv in want.items():
        if c != 32:
            assert digests[c]["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in order(conv)))
            assert digests[c]["loss_sha256"] == sha("".join(r[3] for r in order(conv) if r[2] == "assistant"))
        assert digests[c]["n_turns"] == len(conv)
        assert digests[c]["formatted_chars"] == sum(len(w["text"]) for w in got[c])


def test_windows_of_no_conversation_and_a_history_too_long(spark):
    from marketloom.llm import chat

    assert chat.digests(chat.windows(conversations(spark, []))).isEmpty()
    with pytest.raises(ValueError):
        chat.windows(conversations(spark, []), 100, 30)


@pytest.mark.parametrize("text", ["", "\\", "### ", "\\### ", "\\\\</turn>", "#### x", "a\n</turn>\n### b:\n", "</turn></turn>", "###", "\\### Assistant: </turn> ok"])
def test_escaping_is_reversible_and_hides_control_strings(spark, text):
    from marketloom.llm import chat

    row = spark.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).first()
    assert row["u"] == text
    assert all(row["e"][i - 1 : i] == "\\" for c in (chat.OPEN, chat.CLOSE) for i in range(len(row["e"])) if row["e"].startswith(c, i))


# --- Merkle manifest ------------------------------------------------------------------


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """Levels of a tree, from the leaves to the top."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i - i % 8
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        i //= 8
    return out


def merkle_rows():
    rng = random.Random(4)
    rows = [(i, f"s{i % 3}", "en", 5, f"Text {i} ÄÖ") for i in range(1300)]  # more than one block
    rows += [(2000 + i, None, lang, i, None if i % 2 else "") for lang in ("de", None, "zz", "é") for i in range({"de": 1, None: 8, "zz": 9, "é": 64}[lang])]
    rows += [(5000, "s", "de", 1, "Same")] * 3 + [(None, "s", "de", 1, "No Id")] * 2 + [(7000, "s", "long", 1, "Ab " * 200_000)]
    rows += [(8000 + i, "s", f"l{i}", 0, "X") for i in range(70)]  # more groups than one run
    rng.shuffle(rows)
    return rows


def test_manifest_equals_trees_built_in_python(spark):
    from marketloom.llm import merkle

    rows = merkle_rows()
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos long, block long, tree string, path string")
    got = merkle.manifest(df, with_proofs=True).collect()
    assert len(got) == len(rows)
    as_leaf = lambda r: leaf((r[0], r[1], r[2], r[3], r[4]))
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, as_leaf(r))):
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = {g: tree([as_leaf(r) for r in groups[g]]) for g in names}
    high = tree([low[g][-1][0] for g in names])
    root, want = high[-1][0], []
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = path(low[g], i) + path(high, at)
            lower = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            x = leaf((*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))) if lower else as_leaf(r)
            for left, right in steps:
                x = sha(left + x + right)
            want.append((r[0], as_leaf(r), low[g][-1][0], root, sha("".join(a + b for a, b in steps)), x, x == root, steps))
    key = lambda r: tuple(map(str, r))
    assert sorted(want, key=key) == sorted([(*r[:7], [tuple(s) for s in r["proof"]]) for r in got], key=key)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_empty_and_single_row_tables(spark):
    from marketloom.llm import merkle

    df = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df.limit(0)).isEmpty()
    one = merkle.manifest(df).collect()
    assert [tuple(r) for r in one] == [(1, (h := sha("1:1----")), h, h, sha(""), h, True)]


# --- burst tries ----------------------------------------------------------------------


def plain_trie(sequences):
    """Nodes of the trie of {member: [(item, length)]} by dictionaries of prefixes."""
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * (p[-1][1] if p else 0)
    ends = {p: ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def python_rebuilt(rows):
    convs = {}
    for r in rows:
        if r[0] is not None:
            convs.setdefault(r[0], []).append(r)
    turns = {c: [((r[2] or "", r[3] or ""), len(r[3] or "")) for r in order(v)] for c, v in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def forest():
    rng = random.Random(8)
    said = [f"s{i}" * rng.randrange(1, 4) for i in range(4)]
    rows = []
    for c in [*range(-3, 60), 100, 101, 130, 199, 205, 206]:
        for t in range(rng.randrange(0, 9) + 1):
            rows.append((c, t, ("user", "assistant")[t % 2], rng.choice(said)))
    for c in range(300, 330):  # copies
        rows += [(c, t, "user", f"copy {t}") for t in range(4)]
    for c in range(400, 412):  # long ones that part ways late, at and near the borders of pieces
        rows += [(c, t, "user", "x" if t < 60 + c % 7 else f"y{c % 5 if t > 130 else 0}") for t in range((60, 64, 65, 128, 129, 200, 333)[c % 7])]
    rows += [(500, None, None, None), (500, 3, "user", None), (None, 1, "user", "nobody")]
    rows += [(600, 1, "user", "same")] * 3
    return rows


@pytest.mark.parametrize(("span", "burst"), [(4, 2), (64, 4096)])
def test_trie_of_rebuilt_conversations(spark, monkeypatch, span, burst):
    from marketloom.llm import tries

    monkeypatch.setattr(tries, "SPAN", span)
    rows = forest()
    got = found(tries.nodes(*tries.rebuilt(conversations(spark, rows)), burst=burst))
    assert got == plain_trie(python_rebuilt(rows))


def test_trie_of_no_conversation_and_of_turnless_ones(spark):
    from marketloom.llm import tries

    assert tries.nodes(*tries.rebuilt(conversations(spark, []))).isEmpty()
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)
    got = found(tries.nodes(*tries.rebuilt(conversations(spark, [(c, 0, "user", "gone"), (c, 1, "user", "too")]))))
    assert got == [(c, 0, -1, 1, 0, 1, 0, sha(str(c)))]
