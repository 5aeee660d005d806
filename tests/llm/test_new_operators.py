"""Turn repair, periodic runs and sequence files against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import decontaminate, ngram_join, period_runs, quality_classifier, queries, secret_scan, sequence_files, turn_repair
from tallyweave.session import scratch_folder

from .fixtures import SCHEMA, documents, prose


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


# ---- turn repair

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(symbols):
    """Least (cost, audit) by a programme over whole strings, states named by the last role letter."""

    def with_insertions(best):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit) in list(best.items()):
                for role in "ua":
                    then = AFTER.get((state, role))
                    if then and (cost + 5, audit + "I") < best.get(then, (10**9, "")):
                        best[then], changed = (cost + 5, audit + "I"), True
        return best

    best = {"": (0, "")}
    for role, fault in symbols:
        new, extra = {}, 5 if fault == "t" else 0
        for state, (cost, audit) in with_insertions(best).items():
            ways = [(cost + 2, audit + "D", state)]
            if fault != "x":
                ways += [(cost + extra, audit + "K", AFTER.get((state, role)))]
                ways += [(cost + 1 + extra, audit + "R", AFTER.get((state, r))) for r in "ua"]
            for price, letters, then in ways:
                if then is not None and (price, letters) < new.get(then, (10**9, "")):
                    new[then] = price, letters
        best = new
    best = with_insertions(best)
    return min(best[s] for s in ("", "a") if s in best)


SYMBOLS = [role + fault for role in "suao" for fault in ".tx"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SYMBOLS), st.integers(1, 9)), max_size=7))
def test_repair_is_the_cheapest_and_least(parts):
    symbols = [s for s, n in parts for _ in range(n)]
    assert turn_repair.repair(symbols) == cheapest(symbols)


def faults(rows):
    """Rows (turn, role, text) in order with their faults."""
    seen, out = set(), []
    spaced = [(turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows]
    for turn, role, text in sorted(spaced, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        said = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def expected(rows):
    rows = faults(rows)
    symbols = [(r[1][:1] if r[1][:1] in tuple("sua") else "o") + {"blank": "x", "duplicate": "x", "truncated": "t", None: "."}[r[3]] for r in rows]
    cost, audit = cheapest(symbols)
    out, at, last = [], 0, ""
    for letter in audit:
        if letter == "I":
            role, text = {"u": "assistant"}.get(last, "user"), ""
        else:
            (_, role, text, _), at = rows[at], at + 1
            if letter == "D":
                continue
            role = role if letter == "K" else {"u": "assistant"}.get(last, "user")
        out.append(f"{role}:{text}")
        last = role[0]
    turns = [r[0] for r in rows if r[0] is not None]
    kinds = Counter(r[3] for r in rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in (*range(12), None):
        for turn in range(rng.choice([1, 2, 7, 30])):
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"])
            text = rng.choice(["Yes.", "no", "", None, " \t\n", "Long? " * 3, "Änd 😀!", prose(5, turn) + ".", prose(5, turn)])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    rows += [(50, i, "user", prose(3, i) + ".") for i in range(40)] + [(51, 0, "assistant", "word " * 40_000 + "end.")]
    return rows


@pytest.mark.parametrize(("segment", "fan"), [(4096, 512), (3, 2)])
def test_conversations_of_any_size_are_repaired_in_segments(spark, segment, fan):
    rows = conversations()
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, _key string, pos int").repartition(3)
    edits = turn_repair.repair_conversations(table, segment=segment, fan=fan)
    groups = defaultdict(list)
    for conv, *row in rows:
        groups[conv].append(row)
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in turn_repair.digests(edits).collect()}
    assert got == {conv: expected(part) for conv, part in groups.items()}
    kept = defaultdict(list)
    for r in sorted(turn_repair.repaired(edits).filter("conv_id is not null").collect(), key=lambda r: (r["conv_id"], r["pos"], r["step"])):
        kept[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv in range(12):
        assert hashlib.sha256("\n".join(kept[conv]).encode()).hexdigest() == got[conv][-1]
        letters = "".join(line[0] for line in kept[conv])
        assert re.fullmatch("(s?(ua)+)?", letters)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.digests(turn_repair.repair_conversations(empty)).count() == 0


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in (0, 1)] + [(None, None, None, None)]
    got = Counter(queries.damaged_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        want[(c, t, "user" if f == 4 else role, text)] += {0: 0, 3: 2}.get(f, 1)
    assert got == +want


# ---- columns that have names of the operators' own

CLASHES = ["_text", "_key", "_md5", "_first", "_same", "_own_md5", "_w", "_l", "_row", "_size", "items", "secrets", "score_", "_pos", "_seg", "start"]


@pytest.mark.parametrize("stage", ["near", "clean", "scored", "redacted"])
def test_stages_pass_clashing_columns_through(spark, stage):
    rows = [(i, prose(40, i % 5), *range(len(CLASHES))) for i in range(10)] + [(11, "password: hunter2secret9x " + prose(40, 77), *range(len(CLASHES)))]
    table = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{c} int" for c in CLASHES]]))
    if stage == "near":
        out, count = ngram_join.one_per_class(table), 6
    elif stage == "clean":
        out, count = decontaminate.decontaminate(table, spark.createDataFrame([(1, prose(40, 3))], "item_id long, text string")), 9
    elif stage == "scored":
        labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
        out, count = quality_classifier.score_quality(table, quality_classifier.train(table.select("doc_id", "text"), labels)).drop("score", "predicted"), 11
    else:
        out, count = secret_scan.redact(table), 11
    got = out.collect()
    assert out.columns == table.columns and len(got) == count
    assert all(tuple(r)[2:] == tuple(range(len(CLASHES))) for r in got)
    secret = [r["text"] for r in got if r["doc_id"] == 11][0]
    assert ("hunter2" in secret) == (stage != "redacted") and ("[SECRET]" in secret) == (stage == "redacted")


# ---- periodic runs


def plain_runs(words, min_words=6, min_periods=4):
    found = []
    for q in range(1, len(words) // min_periods + 1):
        i = 0
        while i + q < len(words):
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            end = i + q
            whole = end - a >= max(min_words, min_periods * q)
            if i > a and whole and not any(words[a : end - p] == words[a + p : end] for p in range(1, q)):
                found.append((a, end - a, q))
            i += i == a
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 60)), max_size=5), st.sampled_from([3, 4]))
def test_runs_match_plain_search(parts, min_periods):
    words = [w for unit, n in parts for w in (unit * 60)[:n]]
    assert period_runs.periodic_runs(np.array(words, np.int64), 6, min_periods) == plain_runs(words, 6, min_periods)


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = plain_runs(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    facts = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *facts, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


DIGEST = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_documents():
    rng = random.Random(9)
    made = [(20 + i, " ".join((prose(rng.randint(1, 12), i).split() * 9)[: rng.randint(3, 80)]) + " tail", "en", "a", "x", 1) for i in range(12)]
    return documents() + made + [(40, "ab\tcd\n" * 400 + prose(300, 8), "en", "a", "x", 1), (41, "go " * 400 + "stop " * 9, "en", "a", "x", 1)]


@pytest.mark.parametrize("collide", [False, True])
def test_run_digests_match_plain_search(spark, monkeypatch, collide):
    """Also when all words share one hash: then names come from the bytes. A small chunk parts the documents."""
    rows = periodic_documents()
    if collide:
        found = {}
        monkeypatch.setattr(period_runs, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        for r in rows:
            data = np.frombuffer((r[1] or "").encode(), np.uint8)
            starts, ends, _ = period_runs.words(data, np.array([0, len(data)]))
            found[r[0], r[1]] = period_runs.periodic_runs(period_runs.word_names(data, starts, ends, np.zeros(len(starts), np.int64)))
        assert all(v == plain_runs(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for (_, text), v in found.items())
        return
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("kept", "runs").withColumnRenamed("source", "_key").repartition(3)
    got = Counter(tuple(r[n] for n in DIGEST) for r in period_runs.digests(period_runs.find_runs(table)).collect())
    assert got == Counter(plain_digest(r[0], r[1]) for r in rows)
    assert period_runs.find_runs(table.limit(0)).count() == 0


def test_runs_of_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError, match="three periods"):
        period_runs.periodic_runs(np.zeros(4, np.int64), 4, 2)


def test_planted_periods_follow_the_checksum(spark):
    rows = [(i, prose(5 + i % 40, i)) for i in range(200)] + [(None, "a b"), (3, None)]
    for r in queries.planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows[:200]).get(r["doc_id"]) if r["text"] is not None else None
        h = zlib.crc32(str(r["doc_id"]).encode())
        if text and h % 10 == 0:
            w, g = text.split(), h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            text = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)))
        assert r["doc_id"] is None or r["text"] == text


# ---- sequence files


def encoded(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(k, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for k, t in rows]


@pytest.fixture(scope="module")
def folder(spark, docs):
    place = scratch_folder(spark, "sequences")
    sequence_files.write_sequences(docs, place, length=64)
    return place


def test_documents_read_back_in_order(spark, folder):
    want = encoded([r[:2] for r in documents()])
    got = sorted(sequence_files.read_documents(spark, folder, ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got)
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((k, ids.tobytes()) for k, ids in want)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += r["n_tokens"]


def test_sequences_are_views_of_the_mapped_file(spark, folder):
    found = sequence_files.Sequences(folder)
    total = sum(len(ids) for _, ids in encoded([r[:2] for r in documents()]))
    table = {r["sequence"]: r for r in sequence_files.read_sequences(spark, folder).collect()}
    assert set(table) == set(range(len(found)))
    held, inside, ends = pa.total_allocated_bytes(), 0, 0
    for i in range(len(found)):
        ids, mask, last = found[i]
        assert len(ids) == len(mask) == len(last) == 64 and not ids.flags.owndata and not ids.flags.writeable
        assert table[i]["ids"] == ids.tolist() and table[i]["mask"] == mask.to_pylist() and table[i]["last"] == last.to_pylist()
        inside += mask.true_count
        ends += last.true_count
    assert (inside, ends) == (total, len(documents())) and pa.total_allocated_bytes() - held < 1000
    with pytest.raises(IndexError):
        found[len(found)]


def test_a_folder_is_replaced_only_on_request(spark, folder):
    few = spark.createDataFrame([(1, "new text"), (0, None)], "doc_id int, text string")
    with pytest.raises(Exception, match="holds sequences already"):
        sequence_files.write_sequences(few, folder)
    place = scratch_folder(spark, "sequences")
    for rows in (few, few.limit(1), few):
        sequence_files.write_sequences(rows, place, overwrite=True)
    assert [tuple(r)[:3] for r in sequence_files.read_documents(spark, place).orderBy("start").collect()] == [(0, 0, 1), (1, 1, 3)]


def test_an_empty_table_and_a_damaged_mask(spark):
    place = scratch_folder(spark, "sequences")
    sequence_files.write_sequences(spark.createDataFrame([], "doc_id string, text string"), place)
    assert sequence_files.read_documents(spark, place).count() == 0 and len(sequence_files.Sequences(place)) == 0
    sink = pa.BufferOutputStream()
    made = sequence_files._SequenceSink(sink, np.dtype("u2"), 4, 2)
    for ids in ([5, 6, 2], [7, 8, 9, 10, 11, 12, 2], [2]):
        made.put(np.array(ids, "<u4"))
    made.close()
    spans = sequence_files._Spans(pa.ipc.open_file(sink.getvalue()))
    assert [np.concatenate(list(spans.of(*at))).tolist() for at in ((0, 3), (3, 7), (10, 1))] == [[5, 6, 2], [7, 8, 9, 10, 11, 12, 2], [2]]
    with pytest.raises(ValueError, match="disagree"):
        list(sequence_files._Spans(pa.ipc.open_file(sink.getvalue())).of(0, 4))
