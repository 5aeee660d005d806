"""Archive, chat, sharding, decontamination, join and pipeline against plain Python on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import chat_format, decontaminate, ngram_join, sharding, warc_archive
from tallyweave.llm.common import components, join_groups

from .fixtures import SCHEMA, documents, prose


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


# ---- WARC


def test_archive_round_trip(spark):
    long, short = "<p>" + "a" * 1500, "tiny"
    rows = [(1, "u1", long), (5, "u5", long), (3, None, long), (2, "u\r\n2", short), (4, "u4", short), (6, "u6", None), (7, "u7", ""), (5, "u5", long), (None, "n", long), (8, "ü", "é" * 600)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(2)
    folder = warc_archive.archive_folder(spark)
    warc_archive.write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({r[2] or "" for r in rows})
    got = warc_archive.read_archive(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        body = {str(i) if i is not None else None: (t or "") for i, _, t in rows}[r["page_id"]].encode()
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha1(body).hexdigest()
        same_long = body == long.encode()
        if r["record_type"] == "revisit":
            assert same_long and r["refers_to"] == "5"
        else:
            assert r["refers_to"] is None
    kinds = Counter((r["page_id"], r["record_type"]) for r in got)
    assert kinds[("5", "response")] == 1 and kinds[("5", "revisit")] == 1 and kinds[(None, "revisit")] == 1
    for r in warc_archive.records(spark, folder).collect():
        fields, content = warc_archive.parse_record(bytes(r["record"]))
        assert int(fields["Content-Length"]) == len(content)


def test_empty_archive(spark):
    folder = warc_archive.archive_folder(spark)
    warc_archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc_archive.read_archive(spark, folder).count() == 0


# ---- chat


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b[<"]), st.text("ab\\<[]/s>lbdINST \né", max_size=12)), max_size=5))
def test_default_template_is_reversible_and_located(turns):
    found = chat_format.locate(chat_format.marked, turns)
    assert chat_format.read_marked(found.text) == turns and not found.rewrites
    for (_, text), span, inner in zip(turns, found.spans, found.contents, strict=True):
        assert span[0] <= inner[0] <= inner[1] <= span[1]
        assert chat_format.unescape(found.text[inner[0] : inner[1]]) == text


def test_templates_that_rewrite_history_are_detected():
    def forgets(turns):
        return "".join(f"<{r}>{t if i + 1 == len(turns) else t[:2]}" for i, (r, t) in enumerate(turns))

    assert chat_format.locate(forgets, [("user", "hello"), ("assistant", "there")]).rewrites == [1]

    def trims(turns):
        return "".join(f"<{r}>{t.strip()};" for r, t in turns)

    found = chat_format.locate(trims, [("user", " hello ")])
    assert not found.rewrites and found.text[slice(*found.contents[0])] == "hello"


def test_chats_of_a_table(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, None, None, 0), (2, 0, None, None, 0), (None, 3, "user", "x", 0), (3, None, "assistant", "", 0)]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"t{i}", 0) for i in range(7)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int").repartition(3)
    for section in (3, 512):
        got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(table, section=section)).collect()}
        assert set(got) == {1, 2, 3, 4, None}
        for conv in got:
            mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
            whole = "".join(f"{r}\n{t}\n" for _, r, t in mine)
            loss = "".join(t for _, r, t in mine if r == "assistant")
            assert got[conv]["n_turns"] == len(mine) and got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
            assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_a_long_conversation_is_rendered_whole(spark):
    turns = [("system", "be brief")] + [("user" if i % 2 else "assistant", f"t{i}") for i in range(1, 600)]
    table = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    (got,) = chat_format.format_chats(table).collect()
    assert got["formatted"] == chat_format.marked(turns) and got["formatted"].count(chat_format.START) == 1 and len(got["spans"]) == 600

    def forgets(some):  # from turn 560 on, the first turn is cut
        return "".join(f"<{r}>{t[:2] if i == 0 and len(some) > 560 else t}" for i, (r, t) in enumerate(some))

    (late,) = chat_format.format_chats(table, forgets).collect()
    assert late["rewrites"] == [560] and not any(s["loss"] for s in late["spans"])


def test_chats_are_shuffled_once_and_read_back_whole(spark):
    """Digests are taken where the conversation was rendered; long texts and more text than a batch holds included."""
    odd = "\\l \\\\ [INST] ü <s> 漢字 😀 \\"
    rows = [(c, i, ("user", "assistant", "tool [x]")[i % 3], odd * (1 + 700 * (c % 2) * (i % 2))) for c in range(300) for i in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat_format.digests(chat_format.format_chats(table))
    own = chat_format.format_chats(table)
    shuffles = [x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in (own, got)]
    assert shuffles == [1, 1]
    held = {r["conv_id"]: r for r in got.collect()}
    assert len(held) == 300 and sum(r["formatted_chars"] for r in held.values()) > 3 * chat_format.BATCH_CHARS
    for conv in range(300):
        mine = [(r, t) for c, _, r, t in rows if c == conv]
        whole, loss = "".join(f"{r}\n{t}\n" for r, t in mine), "".join(t for r, t in mine if r == "assistant")
        row = held[conv]
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert (row["n_turns"], row["loss_chars"], row["formatted_chars"], row["n_rewrites"]) == (4, len(loss), len(chat_format.marked(mine)), 0)


def test_prefixes_share_their_escaped_turns(monkeypatch):
    turns = [("user" if i % 2 else "assistant", f"[{i}] \\ <ü>") for i in range(300)] + [("tool", "long [" * chat_format.KEPT_CHARS)]
    plain = "".join(chat_format.escape(t) for _, t in turns)
    assert plain == "".join(t.translate(str.maketrans(chat_format.ESCAPES)) for _, t in turns)
    calls, escape = [], chat_format.escape
    monkeypatch.setattr(chat_format, "escape", lambda text: calls.append(1) or escape(text))
    found = chat_format.locate(chat_format.marked, turns)
    assert len(calls) <= 2 * len(turns)
    assert chat_format.read_marked(found.text) == turns and not found.rewrites
    assert [chat_format.unescape(found.text[slice(*c)]) for c in found.contents] == [t for _, t in turns]


# ---- sharding


def test_ring_gives_equal_counts_gapless_slots_and_little_movement(spark):
    table = spark.range(3001).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text", "1 as shard")
    small = {r["doc_id"]: r for r in sharding.shard_documents(table, 6, 64).collect()}
    large = {r["doc_id"]: r for r in sharding.shard_documents(table, 7, 64).collect()}
    for placed, n in ((small, 6), (large, 7)):
        by = defaultdict(list)
        for r in placed.values():
            by[r["shard"]].append(r["slot"])
        assert len(by) == n and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(small[i]["shard"] != large[i]["shard"] for i in small) / len(small)
    assert 1 / 7 - 0.01 <= moved < 0.35  # a plain modulus would move 6/7


def test_only_rows_above_capacity_leave_their_shard(spark):
    n, shards, replicas = 400, 5, 8
    placed = sharding.shard_documents(spark.range(n).selectExpr("id as doc_id", "'t' as text"), shards, replicas).collect()
    nodes = [(r["node"], r["shard"]) for r in sharding.ring(spark, shards, replicas).orderBy("node").collect()]
    caps = {s: n // shards + (s < n % shards) for s in range(shards)}
    away = sum(r["shard"] != r["home"] for r in placed)
    home = Counter(r["home"] for r in placed)
    assert away == sum(max(0, home[s] - caps[s]) for s in range(shards)) and len(nodes) <= shards * replicas


def test_shards_of_odd_rows(docs):
    got = sharding.shard_documents(docs, 4).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in documents())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    assert all(r["shard"] is not None and r["slot"] is not None for r in got)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0


# ---- decontamination


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=70), st.text("ab", max_size=14))
def test_myers_is_the_edit_distance(pattern, text):
    found = decontaminate.myers(pattern, text, len(pattern))
    least = edits(pattern, text)
    assert (found[0] if found else len(pattern)) == least


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_items_within_the_budget_are_found(seed):
    rng = random.Random(seed)
    item = "".join(rng.choice("abc ") for _ in range(rng.randint(10, 60)))
    item = decontaminate.normalize(item) or "a"
    block = decontaminate.Items.of([item], 0.2)
    copy = list(item)
    for _ in range(rng.randint(0, block.budgets[0] + 1)):
        at = rng.randrange(len(copy) + 1)
        kind = rng.choice("sid")
        if kind == "i":
            copy.insert(at, rng.choice("abc"))
        elif at < len(copy):
            copy[at : at + 1] = [rng.choice("abc")] if kind == "s" else []
    text = decontaminate.normalize("".join(rng.choice("abcd ") for _ in range(20)) + "".join(copy) + "".join(rng.choice("abcd ") for _ in range(20)))
    least = edits(item, text)
    found = block.find(text, block.automaton())
    assert [f[:2] for f in found] == ([(0, least)] if least <= block.budgets[0] else [])


def test_decontamination_of_a_table(spark, docs):
    item = prose(30, 99)
    rows = [(1, "Before\n" + item.upper().replace(" ", "\n ") + " after"), (2, item.replace("owls", "owl")), (3, prose(50, 98)), (4, None), (5, ""), (6, item[: len(item) // 2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, None, 0), (None, "", 0)], "item_id long, text string, extra int")
    got = {r["doc_id"]: [(h["item_id"], h["distance"]) for h in r["items"]] for r in decontaminate.find_items(table, bench).collect()}
    assert got == {1: [(1, 0)], 2: [(1, item.count("owls"))], 3: [], 4: [], 5: [], 6: []}
    assert {r["doc_id"] for r in decontaminate.decontaminate(table, bench).collect()} == {3, 4, 5, 6}
    assert decontaminate.find_items(table, bench.limit(0)).count() == 6 and decontaminate.find_items(table.limit(0), bench).count() == 0
    assert decontaminate.find_items(docs, bench).count() == len(documents())


# ---- join


def jaccard(a, b):
    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a and b else 0


def expected_join(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    degree = [0] * len(rows)
    for i, a in enumerate(rows):
        for j in range(i):
            if jaccard(a[1], rows[j][1]) >= 0.8:
                degree[i] += 1
                degree[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out[(r[0], min(ids) if ids else None, degree[i])] += 1
    return out


@pytest.mark.parametrize("blocks", [(4096, 512), (5, 3)])
def test_join_counts_every_link(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(ngram_join, "SET_BLOCK", blocks[1])
    base = prose(120, 5).split()
    rows = [(r[0], r[1]) for r in documents()]
    for i in range(30):
        words = list(base)
        for k in range(i % 5):
            words[(i * 37 + k * 11) % 120] = f"w{i}{k}"
        rows.append((100 + i, " ".join(words)))
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_links int").repartition(4)
    got = ngram_join.jaccard_join(table)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == expected_join(rows)
    kept = ngram_join.one_per_class(table)
    classes = {(r["class_set"]) for r in got.collect() if r["class_set"]}
    assert kept.columns == table.columns and kept.count() == len(classes) + sum(not (t or "").split() for _, t in rows)


def test_join_of_tables_without_links(spark):
    table = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)], "doc_id long, text string")
    assert {(r["class_id"], r["n_links"]) for r in ngram_join.jaccard_join(table).collect()} == {(1, 0), (2, 0), (3, 0)}
    assert ngram_join.jaccard_join(table.limit(0)).count() == 0 and ngram_join.one_per_class(table).count() == 3


def test_pruning_keeps_pairs_at_the_threshold():
    from math import comb

    for n in (16, 32, 48, 64):
        m = ngram_join.least_matches(n)
        lost = sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert lost < 1e-7 and m > 0


# ---- helpers and pipeline


def test_components_of_a_long_path(spark):
    path = spark.range(200).selectExpr("id as a", "id + 1 as b")
    other = spark.createDataFrame([(900, 901), (901, 901)], "a long, b long")
    roots = {r["vertex"]: r["root"] for r in components(path.union(other)).collect()}
    assert roots == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_join_groups_beyond_the_broadcast_limit(spark):
    rows = spark.range(1000).selectExpr("case when id < 400 then null else id % 50 end as k", "id")
    groups = rows.groupBy("k").count()
    for limit in (3, 1000):
        got = join_groups(rows, groups, ["k"], "count", "left", limit)
        assert Counter((r["k"], r["count"]) for r in got.collect()) == Counter({(None, 400): 400} | {(i, 12): 12 for i in range(50)})


def test_pipeline_matches_plain_python(spark):
    """Every stage on the smallest tables against what it must keep."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "packing"]
    good = stages["quality_classifier"](spark, source, folder).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.95 and good.columns == source.columns
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    unique = stages["ngram_jaccard_join"](spark, good, folder).cache()
    assert {r["doc_id"] for r in unique.collect()} == {c for _, c, _ in expected_join(rows)}
    bench = [decontaminate.normalize(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = stages["benchmark_decontamination"](spark, unique, folder).cache()
    leaked = {r["doc_id"] for r in unique.collect() if any(b in decontaminate.normalize(r["text"]) for b in bench)}
    assert {r["doc_id"] for r in unique.collect()} - {r["doc_id"] for r in clean.collect()} == leaked
    from tallyweave.llm import secret_scan

    redacted = stages["secret_scans"](spark, clean, folder).cache()
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in redacted.collect():
        assert r["n_chars"] == len(r["text"]) and not secret_scan.base_spans(r["text"])
        assert r["text"] == before[r["doc_id"]] or secret_scan.base_spans(before[r["doc_id"]]) or "[SECRET]" in r["text"]
    assert redacted.columns == source.columns and redacted.count() == clean.count()
    packed = stages["packing"](spark, redacted, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(before)
