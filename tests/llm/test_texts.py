"""Mixing, decontamination, personal data, licences, chat formatting and tokenising against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import ALNUM, SPACE, documents, low, texts
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, licenses, mixing, pii, tagger, textcore


@pytest.mark.parametrize(("table", "pattern"), [(textcore.SPACE, SPACE), (textcore.ALNUM, ALNUM)])
def test_tokens(monkeypatch, table, pattern):
    monkeypatch.setattr(textcore, "CHUNK", 64)
    monkeypatch.setattr(textcore, "_TABLES", {})
    found = texts(80)
    hashes, first = textcore.tokenize(pa.array(["skipped", *found]).slice(1), table)
    seen: dict = {}
    for i, t in enumerate(found):
        words = pattern.findall(low(t))
        assert len(words) == first[i + 1] - first[i]
        for w, h in zip(words, hashes[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


# ---- mixing


def brute_targets(sizes, weights, total, most):
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in above]
    return out


@pytest.mark.parametrize(("sizes", "share"), [([100, 100, 100], 1.0), ([10, 1000, 10], 1.0), ([0, 0], 1.0), ([], 1.0), ([1, 2, 3, 500, 4, 0, 7000], 1.0), ([5, 5, 5], 3.0), ([5, 50, 5], 2.5)])
def test_targets_stop_at_the_cap(spark, sizes, share):
    rows = spark.createDataFrame([(f"s{i:02}", f"s{i:02}", n) for i, n in enumerate(sizes)], "key string, source string, source_size long")
    got = [r["target"] for r in mixing.targets(rows, (1, 2, 3), share, 3).orderBy("n").collect()]
    assert got == brute_targets(sizes, [1.0 + i % 3 for i in range(len(sizes))], sum(sizes) * share, 3)


def brute_highest_quotients(votes, seats):
    """Seats by all quotients v / 1, v / 3, v / 5, ...; ties by place."""
    ranked = sorted((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) if v for k in range(seats))[:seats]
    return [sum(i == j for _, j, _ in ranked) for i in range(len(votes))]


@pytest.mark.parametrize(("votes", "seats"), [([53, 24, 23], 7), ([1, 1, 1, 1], 3), ([10_000, 1, 1, 1], 2), ([5, 0, 7], 40), ([3], 9), ([0, 0], 4), ([8, 8, 8], 0), ([1] * 30 + [500], 12), ([91, 17, 17, 17, 3, 2, 1], 61)])
def test_quotas_are_the_highest_quotients(spark, votes, seats):
    want = brute_highest_quotients(votes, seats)
    one = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "name int, votes long, seats long")
    two = spark.createDataFrame([(g, i, v, seats + g) for g in (0, 1) for i, v in enumerate(votes)], "g int, name int, votes long, seats long")
    got = {r["name"]: r["quota"] for r in mixing.apportion(one, [], ["name"], "votes", "seats").collect()}
    assert [got.get(i, 0) for i in range(len(votes))] == want
    got = {(r["g"], r["name"]): r["quota"] for r in mixing.apportion(two, ["g"], ["name"], "votes", "seats").collect()}
    assert [[got.get((g, i), 0) for i in range(len(votes))] for g in (0, 1)] == [want, brute_highest_quotients(votes, seats + 1)]


def test_shards_give_what_their_quotas_say(spark):
    words, block = [1000, 1700, 64, 3333, 0, 905], 100
    shards = spark.createDataFrame([("=a", i, w) for i, w in enumerate(words)] + [("=b", 0, 7)], "key string, shard long, words long")
    goals = spark.createDataFrame([("=a", sum(words), 4321.0), ("=b", 7, 21.0)], "key string, source_size long, target double")
    got = {(r["key"], r["shard"]): r for r in mixing.plan(shards, goals, 3, block, 1).collect()}
    seats = brute_highest_quotients([4321, 21], 43)
    assert [got["=a", i]["quota"] for i in range(len(words))] == brute_highest_quotients(words, seats[0]) and got["=b", 0]["quota"] == seats[1]
    given = {k: r["passes"] * r["words"] + r["rest"] for k, r in got.items()}
    assert sum(v for k, v in given.items() if k[0] == "=a") == 4321 and given["=b", 0] == 21
    # all but the largest shard give whole blocks
    assert all(given["=a", i] == block * got["=a", i]["quota"] for i in range(len(words)) if i != 3)
    assert all(r["from"] % block == 0 and 0 <= r["rest"] <= r["words"] for r in got.values())


def mixed_right(rows, got, most=3):
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    size, taken = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for _, t, s in rows:
        size[s] += len(SPACE.findall(t or ""))
    want = dict(zip(names, brute_targets([size[n] for n in names], [1.0 + i % 3 for i in range(len(names))], sum(size.values()), most), strict=True))
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == want[r["source"]] and 0 <= r["taken"] <= most * r["size"], r
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[n] - want[n]) <= 0.5 for n in names)


@pytest.mark.parametrize("shard_rows", [16_384, 100, 3])
def test_mix(spark, shard_rows):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "ä", "Z", "", None])) for i in range(900)] + [(5, "w w", "a"), (5, "w w", "a"), (None, "w w w", "b"), (7, None, "b"), (8, "x", "tiny")]
    docs = documents(spark, rows)
    got = mixing.mix(docs, shard_rows=shard_rows, max_block=64, blocks=400).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), shard_rows=shard_rows, max_block=64, blocks=400).collect()), key=str)
    mixed_right(rows, got)


def test_mix_of_nothing(spark):
    docs = documents(spark, [(1, "", "a"), (2, None, None)])
    assert {(r["taken"], r["target"]) for r in mixing.mix(docs).collect()} == {(0, 0.0)}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_of_many_small_sources(spark):
    rows = [(3 * i + j, "w", f"s{i:05}") for i in range(5000) for j in range(3)]
    mixed_right(rows, mixing.mix(documents(spark, rows, extra=False)).collect())


# ---- decontamination


def brute_hits(text, items, size=10):
    words = ALNUM.findall(low(text))
    hit, ids, near = set(), set(), set()
    for item, t in items:
        w = ALNUM.findall(low(t))
        k = min(size, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            for p in range(len(words) - k + 1):
                same = sum(a == b for a, b in zip(words[p : p + k], w[j : j + k], strict=True))
                if same == k:
                    hit |= set(range(p, p + k))
                    ids.add(item)
                elif k == size and same >= k - 2:
                    near.add(item)
    return len(words), len(hit), ids, near - ids


@pytest.mark.parametrize(("block_bytes", "segment_bytes"), [(1 << 24, 2 << 20), (400, 900)])
def test_benchmark_matches(spark, block_bytes, segment_bytes):
    rng = random.Random(6)
    found = texts(60, seed=5)
    long_ones = [t for t in found if t and len(t.split()) > 30]
    items = [(1, long_ones[0][:120]), (2, "ONE two"), (3, ""), (4, None), (5, " ".join(long_ones[1].split()[3:25])), (6, "never seen words in here"), (5, "one"), (None, "one two"), (12, " ".join(long_ones[2].split()[:14]))]
    changed = long_ones[2].split()[:14]
    changed[4] = "zzz"
    docs = list(enumerate(found)) + [(900, " ".join(changed)), (901, "!!" + long_ones[1].upper()), (3, found[3]), (None, "one two")]
    rng.shuffle(docs)
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id long")
    got = decontaminate.decontaminate(documents(spark, docs), bench, block_bytes=block_bytes, segment_bytes=segment_bytes).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    live = [x for x in items if x[0] is not None]
    for i, t in docs:
        n, hit, ids, near = brute_hits(t, live)
        r = by[i][0]
        assert (r["n_words"], r["n_hit"], set(r["items"]), set(r["near_items"])) == (n, hit, ids, near), (i, t)
        assert sum(s["end"] - s["start"] for s in r["spans"]) >= hit
    assert any(r["near_items"] for r in got)
    assert decontaminate.decontaminate(documents(spark, docs).limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(documents(spark, docs), bench.limit(0)).collect()} == {0}


def test_an_index_holds_every_token(monkeypatch):
    found = texts(50, seed=9)
    part = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([7] * 50, pa.int64()), pa.array(found, pa.string())], names=["doc_id", "row_key", "text"])
    row = decontaminate._segment(part).to_pylist()[0]
    terms, ends = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["doc_end"], np.int64)
    positions, first, last = decontaminate._postings(row, terms)
    begin = np.r_[0, ends[:-1] + 1]
    got = {}
    for t, a, z in zip(terms.tolist(), first.tolist(), last.tolist(), strict=True):
        for p in positions[a:z].tolist():
            d = int(np.searchsorted(ends, p, "left"))
            got[d, p - int(begin[d])] = t
    want = {(d, i): textcore.word_hash(w, textcore.ALNUM)[0] for d, t in enumerate(found) for i, w in enumerate(ALNUM.findall(low(t)))}
    assert got == want
    query = decontaminate.windows([(i, found[i]) for i in range(20, 40)], 10)
    whole = decontaminate._search_segment(row, query, 2)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 3)
    assert decontaminate._search_segment(row, query, 2) == whole


def test_cost_follows_the_hits():
    """A block of many windows that a segment does not hold opens no posting list."""
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(300)]
    query = decontaminate.windows(items, 10)
    terms = np.sort(np.unique(textcore.tokenize(pa.array(["quite other words " * 50]), textcore.ALNUM)[0]))
    assert len(query.grams) == 300 * 191 and list(decontaminate._locate(terms, lambda: pytest.fail("opened"), 500, query, 2)) == []


# ---- personal data


def test_base_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(text):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m.group())
                if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                    out.append((kind, m.start(), m.end()))
        return out

    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("ab.@-+1203 ()é") for _ in range(rng.randint(0, 34)))
        assert pii.base_spans(t) == brute(t)
    assert pii.base_spans("4111 1111-1111 1111 and " + "9" * 5000) == [("card", 0, 19)]


def test_tagger_gradients():
    model, rng = tagger.Tagger(4, 3, dtype=np.float64), np.random.default_rng(0)
    codes, tags = rng.integers(0, tagger.N_CODES, (3, 7)), rng.integers(0, tagger.N_TAGS, (3, 7))
    _, g = model.loss(codes, tags)
    for k, p in model.p.items():
        at = (int(codes[0, 2]), 1) if k == "emb" else tuple(int(rng.integers(0, s)) for s in p.shape)
        p[at] += 1e-5
        up = model.loss(codes, tags)[0]
        p[at] -= 2e-5
        down = model.loss(codes, tags)[0]
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5


def test_viterbi_and_marginals_by_enumeration():
    model, rng = tagger.Tagger(4, 3, dtype=np.float64), np.random.default_rng(1)
    model.p["trans"][:] = rng.normal(size=model.p["trans"].shape)
    codes = rng.integers(0, tagger.N_CODES, (1, 3))
    e, trans, first = model._emissions(codes)[0][:, 0], model.p["trans"], model.p["first"]
    score = {s: first[s[0]] + sum(e[t, k] for t, k in enumerate(s)) + sum(trans[a, b] for a, b in zip(s, s[1:], strict=False)) for s in itertools.product(range(tagger.N_TAGS), repeat=3)}
    best, total = max(score, key=score.get), sum(np.exp(v) for v in score.values())
    tags, sure = model.decode(codes)
    assert tuple(tags[0]) == best
    assert np.allclose(sure[0], [sum(np.exp(v) for s, v in score.items() if s[t] == best[t]) / total for t in range(3)])


def test_tagger_reads_whole_addresses():
    found = ["jane.doe [at] universitydept [dot] edu", "firstname.secondname.lastname [at] mail [dot] org"]
    for address in found:
        text = f"please write to {address} now"
        assert pii.find([text], pii.trained())[1] == [[("email", 16, 16 + len(address))]], address
    others = ["name at example dot com", f"{'long.' * 20}name (at) {'department' * 9} (dot) edu", f"4111{' ' * 50}1111{' ' * 50}1111{' ' * 50}1111", f"10{' ' * 50}.{' ' * 50}0.0.1", 'key = "abcdefgh"']
    for span in [*found, *others]:
        text = f"{'word ' * 30}{span}{' word' * 30}"
        start = text.index(span)
        assert any(lo <= start and start + len(span) <= hi for _, lo, hi in pii.regions(text, 0)), span
    assert pii.regions("no span here " * 50, 0) == []


def test_tagger_on_unseen_spellings():
    """Spans that no base pattern finds: of each kind at least so many are found whole, and few others are added."""
    model = pii.trained()
    examples = pii.labelled_examples(500, seed=77)
    base, added = pii.find([t for t, _ in examples], model)
    missed = [(set(spans) - set(b), set(a)) for (_, spans), b, a in zip(examples, base, added, strict=True)]
    for kind, share in {"email": 0.75, "ip": 0.9, "card": 0.9, "phone": 0.65, "secret": 0.9}.items():
        total = sum(s[0] == kind for m, _ in missed for s in m)
        assert total > 30 and sum(s[0] == kind for m, a in missed for s in m & a) >= share * total, kind
    hit, wrong = sum(len(m & a) for m, a in missed), sum(len(a - m) for m, a in missed)
    assert wrong <= 0.06 * hit, (hit, wrong)
    clean, extra = pii.find(["nothing here", "version 2.0 of 2024-01-15, 12 of 40 at 10:30", "", "see you at 5 dot"], model)
    assert not any(clean) and not any(extra)


def test_added_spans_on_documents(spark):
    """On whole documents: every planted token is found, and nothing else is added."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    found = [r["text"] or "" for r in rows]
    _, added = pii.find(found, pii.trained())
    want = sorted((i, *m.span(1)) for i, t in enumerate(found) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t))
    assert len(want) > 5 and sorted((i, a, z) for i, x in enumerate(added) for kind, a, z in x if kind == "secret") == want
    assert sum(kind != "secret" for x in added for kind, _, _ in x) <= 2


def test_long_texts_are_read_to_the_end(spark):
    tail = "x " * 40_000 + "reach bob@example.com"
    rows = documents(spark, [(1, tail), (2, None), (3, ""), (1, tail)])
    got = pii.detect(rows, keep=("lang",)).collect()
    assert [len(r["base"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [1, 1, 0, 0]
    masked = pii.detect(rows).select(pii.mask(F.col("text"), F.concat("base", "added")).alias("t")).collect()
    assert sorted((r["t"] or "")[-7:] for r in masked) == ["", "", "[EMAIL]", "[EMAIL]"]
    one = documents(spark, [(1, "é 10.0.0.1 and +1 (555) 555-1234, a@b.co")])
    assert pii.detect(one).select(pii.mask(F.col("text"), F.concat("base", "added")).alias("t")).first()["t"] == "é [IP] and [PHONE], [EMAIL]"


# ---- licences


def test_licence_places(spark):
    rng = random.Random(9)
    pieces = ["MIT License", "mit  license", "apache-license", "General Public License", "license mit license license", "GNU General Public License, version 3", "Licensed under CC BY-NC 4.0.", "word", "the", "public", "x.y", "Kit license"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(200)] + [(900, None), (901, ""), (3, "mit license"), (None, "mit license")]
    rows += [(902, licenses.NOTICES["mit-notice"] + " " + "z " * 50 + licenses.NOTICES["bsd-notice"].replace("binary", "")), (903, licenses.NOTICES["mit-notice"][:60])]
    got = licenses.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        w = ALNUM.findall(low(t))
        want.setdefault(i, []).append((len(w), sorted((k, p) for k, s in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(s.split())] == s.split())))
    for r in got:
        assert (r["n_words"], [(b["label"], b["start"]) for b in r["base"]]) in want[r["doc_id"]], r
    by = {r["doc_id"]: r for r in got}
    assert {o["label"] for o in by[902]["own"]} == {"mit-notice", "bsd-notice"} and not by[903]["own"] and by[903]["score"] == 0
    whole = licenses.TEXTS["mit-text"]
    some = documents(spark, [(1, f"x y z {whole} tail"), (2, whole.replace("furnished", "given").replace("SOFTWARE IS", "PROGRAM IS")), (3, " ".join(w + " so" for w in whole.split())), (4, " ".join(sorted(whole.split())))])
    found = {r["doc_id"]: {o["label"]: (o["start"], o["end"]) for o in r["own"]} for r in licenses.scan(some).collect()}
    size = len(re.findall("[a-z0-9]+", whole.lower()))
    assert found[1]["mit-text"] == (3, 3 + size) and "mit-text" in found[2] and not found[3] and not found[4]
    assert all(0 <= r["score"] <= 1 for r in got) and licenses.scan(documents(spark, rows).limit(0)).count() == 0
    plan = licenses.scan(documents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- chat


def test_escapes_are_reversible():
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice(["<|", "|", "<", "\\", "[INST]", "[/INST]", "<s>", "</s>", "s>", "[", "INST]", "im_end|>", "é", "\n"]) for _ in range(rng.randint(0, 9)))
        (e,) = chat.escape(pa.array([t])).to_pylist()
        assert chat.unescape(e) == t and not re.search(r"<\||</?s>|\[/?INST\]", e)
        (r,) = chat.escape_role(pa.array([t])).to_pylist()
        assert chat.unescape_role(r) == t and "\n" not in r


@pytest.mark.parametrize("part", [4 << 20, 50])
def test_chat(spark, part):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["hi", "", None, "</s>[INST] x", "é" * 70, "<|im_end|>\n", "long " * 4000])) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "a"), (50, None, "assistant", "b"), (50, 1, None, "c"), (50, 1, None, "c"), (-1, 0, "we\\ird\nrole", "x")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, part long")
    made = chat.format_chat(df, part_bytes=part)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, (x[3] or "").encode()))
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv
    parts = made.collect()
    assert sum(len(p["formatted"]) for p in parts if p["conv_id"] == 3) == got[3]["formatted_chars"]
    assert (len(parts) > len(got)) == (part == 50)
    assert chat.digests(chat.format_chat(df.limit(0))).count() == 0


def test_no_generated_span_lies_outside_the_regions():
    """Ten seeds of the generator, all kinds: every span is read whole."""
    for seed in range(100, 110):
        for text, spans in pii.labelled_examples(1500, seed):
            read = pii.regions(text, 0)
            assert all(any(lo <= start and end <= hi for _, lo, hi in read) for _, start, end in spans), (text, spans)
    for text in ('key: "OrYmxmYlKvx"', "password: Correcthorse!x", "TOKEN: " + "QWERTYUIOPasdfghjkl" * 5, "x 'abcdefghij' y", "deadbeef" * 5):
        assert any(hi - lo >= len(text) - 12 for _, lo, hi in pii.regions(text, 0)), text


def test_best_coverage_counts_all_merged_diagonals(spark):
    rows = [(1, "mit license"), (2, licenses.NOTICES["mit-notice"][:60]), (3, "word"), (4, None), (5, licenses.NOTICES["mit-notice"])]
    got = {r["doc_id"]: (r["score"], r["best"]) for r in licenses.scan(documents(spark, rows)).collect()}
    assert got[1] == (0, 1) and got[2][0] == 0 and 0 < got[2][1] < 0.8 and got[3] == got[4] == (0, 0) and got[5] == (1, 1)
