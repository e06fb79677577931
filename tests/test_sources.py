import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from glossa import session
from glossa.plans import experiments as ex
from glossa.plans import registry
from glossa.sources import files, schemas
from glossa.streaming import calls as st

from .conftest import rows


def test_csv_with_newline_hash_and_quotes(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('# a comment\nid,note\n1,"two\nlines, # kept, ""quoted"""\n# gone\n2,z#w\n', encoding="utf-8")
    got = files.read_stimuli(spark, str(path), "id int, note string")
    assert rows(got) == [(1, 'two\nlines, # kept, "quoted"'), (2, "z#w")]


def test_jsonl_skips_blank_lines_and_keeps_unicode(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.jsonl").write_text('{"a": 1, "t": "é"}\n\n   \n{"a": 2}\n', encoding="utf-8")
    df = files.read_jsonl(spark, str(tmp_path / "in"), "a int, t string")
    assert rows(df) == [(1, "é"), (2, None)]
    files.write_jsonl(df, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert "é" in text


def test_prompt_library(spark, tmp_path):
    template = 'Judge {domain}: {"score": <int>}'
    library = {"system_prompt": "S", "exp2": {"template": "Describe {concept}."}, "exp3": {"levels": {"L0": "a", "L1": "b"}}, "judge": {"template": template}}
    (tmp_path / "p.json").write_text(json.dumps(library, indent=1))
    prompts = files.read_prompts(spark, str(tmp_path / "p.json"))
    assert files.prompt_text(prompts, "exp2", "template") == "Describe {concept}."
    assert files.prompt_text(prompts, "exp3", "L1", "levels") == "b"
    assert files.prompt_text(prompts, "judge", "template") == template
    with pytest.raises(KeyError):
        files.prompt_text(prompts, "exp9", "template")


def test_ground_truth_files(spark, tmp_path):
    (tmp_path / "medical_test_ground_truth.txt").write_text("line 1\nline 2", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("x")
    assert rows(files.read_ground_truth(spark, str(tmp_path))) == [("medical_test", "line 1\nline 2")]


def test_tags_of_legacy_names(spark, tmp_path):
    for name in ("responses_gpt4o_T08.jsonl", "responses_my_model_T12.jsonl", "responses_llama_T0.jsonl"):
        (tmp_path / name).write_text('{"a": 1}\n')
    got = files.tagged_records(spark, str(tmp_path), "a int").select("file_model", "file_temperature")
    assert rows(got) == [("gpt4o", 0.8), ("llama", 0.0), ("my_model", 1.2)]


def test_response_slices_are_pruned_and_replaced(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([("a", 0.2, 1), ("a", 0.8, 2), ("b", 0.8, 3)], "model string, temperature double, i int")
    files.write_responses(df, path)
    files.write_responses(df.filter("model = 'b'").withColumn("i", F.lit(9)), path)
    back = spark.read.schema(df.schema).parquet(path)
    assert rows(back.select("model", "temperature", "i")) == [("a", 0.2, 1), ("a", 0.8, 2), ("b", 0.8, 9)]
    plan = back.filter("model = 'a' and temperature = 0.8")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan


def test_bad_judge_replies_are_kept_apart(spark):
    good = json.dumps({"factual_accuracy": 5, "practical_actionability": 4, "domain_precision": 3, "brief_justification": "ok"})
    bad = ["{", "not json", json.dumps({"factual_accuracy": 5}), None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate([good, *bad])], "i int, reply string")
    ok, quarantine = files.split_scores(files.parse_scores(df, "reply", schemas.JUDGE_REPLY, schemas.SCORE_FIELDS))
    assert [(r["i"], r["factual_accuracy"], r["brief_justification"]) for r in ok.collect()] == [(0, 5, "ok")]
    assert [r["i"] for r in quarantine.orderBy("i").collect()] == [1, 2, 3, 4]


def test_paragraph_rules(spark):
    text = "\n".join(["  " + "x" * 81 + "\t", "y" * 80, ""] + ["z" * 90] * 60)
    got = files.paragraphs(spark.createDataFrame([(1, text)], "id int, t string"), "t", "id").collect()
    assert len(got) == 50
    assert (got[0]["para_index"], got[0]["paragraph"]) == (0, "x" * 81)
    assert (got[1]["para_index"], got[1]["paragraph"]) == (1, "z" * 90)


def test_stored_pages(spark):
    reply = json.dumps({"query": {"pages": {"7": {"title": "A", "extract": "abc", "revisions": [{"revid": 1}, {"revid": 2}]}, "-1": {"title": "B", "extract": ""}}}})
    pages = files.stored_pages(spark.createDataFrame([("c", reply)], "c string, r string"), "r", schemas.PAGE_REPLY, "c")
    assert rows(files.page_measures(pages, "title")) == [("A", 3, 2), ("B", None, 0)]


def test_resume(spark):
    design = spark.createDataFrame([("p", i) for i in range(4)], "prompt string, response_index int")
    done = design.filter("response_index in (1, 3)").unionByName(design.filter("response_index = 1"))
    assert rows(files.resume(design, done, ["prompt", "response_index"])) == [("p", 0), ("p", 2)]


class FakeSession:
    def __init__(self, master, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    assert session.shared_dir(FakeSession("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(FakeSession("yarn", None), "x")
    assert session.shared_dir(spark, "x") != session.shared_dir(spark, "x")


def test_texts_are_dealt_out_on_request_only(spark, sf):
    plan = lambda: registry.texts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan()
    spark.conf.set(registry.SPREAD, "3")
    try:
        assert "RoundRobinPartitioning(3)" in plan()
    finally:
        spark.conf.unset(registry.SPREAD)


# --- request tables ---------------------------------------------------------


def test_request_counts(spark):
    concepts = spark.range(40).select(
        F.format_string("E2_%03d", "id").alias("concept_id"), F.concat(F.lit("c"), "id").alias("concept"),
        F.when(F.col("id") < 20, "charged").otherwise("control").alias("concept_type"),
    )
    three = ["gpt4o", "llama", "mistral"]
    requests = ex.concept_requests(concepts, "Tell me about {concept}.", three)
    assert requests.count() == 48_000
    assert requests.select("model", "temperature", "concept_id", "response_index").distinct().count() == 48_000
    later = ex.generation_requests(concepts, "Describe {concept}.")
    assert later.count() == 4_000
    assert later.filter("concept_type = 'stable'").select("concept").distinct().count() == 10
    assert later.select("generation", "model").distinct().count() == 4
    pairs = spark.range(50).select(
        F.col("id").cast("string").alias("item_id"), F.lit("w").alias("target_word"), F.lit("a w").alias("sentence_a"), F.lit("b w").alias("sentence_b"),
        F.lit("truth").alias("ground_truth_reading"), F.lit("deep").alias("inferential_depth"), F.lit(True).alias("is_critical_item"),
    )
    both = ex.pair_requests(pairs, "'{target}' in: {sentence}", three)
    assert both.count() == 12_000
    first = both.filter("sentence_col = 'sentence_a'").first()
    assert (first["prompt"], first["ground_truth"]) == ("'w' in: a w", None)
    terms = spark.createDataFrame([("E1_001", "bank", "high", "p1", "p2", "p3", " ", None)], "item_id string, target_word string, ambiguity_band string, prompt_P1 string, prompt_P2 string, prompt_P3 string, prompt_P4 string, prompt_P5 string")
    assert ex.term_requests(terms, three).count() == 3 * 3 * 20


def test_domain_requests(spark):
    domains = spark.createDataFrame([("landlord_tenant",), ("cover_letter",)], "domain string")
    got = ex.domain_requests(domains, ["m"])
    assert got.count() == (16 + 4) * 30
    full = got.filter("D and R and V and C and is_focal").first()
    assert (full["condition_id"], full["n_components"], full["level"]) == ("DRVC", 4, 3)
    assert got.filter("R and not D and is_focal").first()["level"] is None
    level = got.filter("domain = 'cover_letter' and level = 2").first()
    assert (level["D"], level["R"], level["V"], level["C"], level["n_components"]) == (True, True, True, False, 3)


def test_domain_prompts(spark):
    domains = spark.createDataFrame([("landlord_tenant",), ("cover_letter",), ("no_such",)], "domain string")
    focal = [("exp3", "example_domain_landlord_tenant", n, n.lower()) for n in ("L0", "L3", "D", "R", "V")]
    other = [("exp3", "example_domain_cover_letter", f"L{i}", f"letter {i}") for i in range(3)]
    library = spark.createDataFrame([*focal, *other, ("exp3", "levels", "L0", "x"), ("exp1", None, "t", "y")], "experiment string, part string, name string, text string")
    got = ex.domain_requests(domains, ["m"], library).filter("response_index = 0")
    prompts = {(r["domain"], r["condition_id"]): r["prompt"] for r in got.collect()}
    # Constraints have no text of their own, so only the level that has one keeps them.
    assert len(prompts) == 8 + 1 + 3
    assert prompts["landlord_tenant", "DRVC"] == "l3"
    assert prompts["landlord_tenant", "~D~R~V~C"] == "l0"
    assert prompts["landlord_tenant", "DR~V~C"] == "r l0 d"
    assert prompts["cover_letter", "L2"] == "letter 2"
    assert rows(ex.domains_without_prompts(domains, library)) == [("no_such", 1)]


def test_judge_requests(spark):
    responses = spark.createDataFrame([("d", "gpt4o", "r1"), ("nope", "gpt4o", "r2")], "domain string, model string, response string")
    truth = spark.createDataFrame([("d", "gt")], "domain string, ground_truth string")
    got = ex.judge_requests(responses, truth, '{domain}|{ground_truth}|{response} {"score": 1}', {"gpt4o": "mistral"})
    assert [(r["judge_model"], r["judge_prompt"]) for r in got.collect()] == [("mistral", 'd|gt|r1 {"score": 1}')]


# --- whole analyses ---------------------------------------------------------


def test_critical_items_flow(spark):
    draft = spark.createDataFrame(
        [("i1", "bank", "deep"), ("i2", "loom", "deep"), ("i3", "tariff", "medium"), ("i4", "zzz", "shallow")], "item_id string, target_word string, inferential_depth string"
    )
    meta = spark.createDataFrame(
        [("i1", "bank.n.02", "bank.n.01", "usury", "river"), ("i2", "loom.n.01", "loom.n.01", "x", "y"), ("i3", "tariff.n.01", "tariff.n.01", "x", "y")],
        "item_id string, enc_synset string, dict_synset string, enc_ctx string, dict_ctx string",
    )
    manual = spark.createDataFrame([("i3", "because")], "item_id string, manual_rationale string")
    counts = spark.createDataFrame([("bank", "bank.n.01", 7), ("bank", "bank.n.02", 2)], "lemma string, synset string, n bigint")
    inventory = spark.createDataFrame([("loom", "loom.n.01", 1), ("tariff", "duty.n.03", 1)], "lemma string, synset string, sense_rank int")
    zipf = spark.createDataFrame([("river", 5.0), ("usury", 2.5)], "token string, zipf double")
    out = ex.critical_items(draft, meta, manual, counts, inventory, zipf)
    got = {r["item_id"]: r for r in out["analysis"].collect()}
    assert {k: (r["tier"], r["verification_source"]) for k, r in got.items()} == {
        "i1": ("T1_auto", "semcor(n=7)"), "i2": ("-", "wordnet_ordering(n=0)"),
        "i3": ("T3_manual", "wordnet_ordering(n=0)+manual"), "i4": ("-", "none(n=0)"),
    }
    assert got["i3"]["manual_rationale"] == "because" and got["i4"]["zipf_enc_ctx"] is None
    assert out["locked"].columns[:3] == draft.columns and out["locked"].count() == 4
    assert [r["item_id"] for r in out["listing"].collect()] == ["i1", "i3"]


def test_accuracy_flow(spark):
    data = []
    for s, m in enumerate(["gpt4o", "llama"]):
        for i in range(120):
            hit = (i * (s + 3)) % 5 < 3 - (i % 3 == 2)
            data.append((m, f"i{i % 10}", "sentence_b" if i % 4 else "sentence_a", ["shallow", "medium", "deep"][i % 3], i % 2 == 0, 0.0, "the truth" if hit else "no", "TRUTH"))
    schema = "model string, item_id string, sentence_col string, inferential_depth string, is_critical_item boolean, temperature double, response string, ground_truth string"
    responses = spark.createDataFrame(data, schema)
    baseline = responses.filter("model = 'llama'").withColumn("model", F.lit("gpt2-xl"))
    out = ex.accuracy_analysis(responses, baseline, ["gpt2_xl", "gpt4o", "llama"])
    acc = {tuple(r)[:3]: (r["accuracy"], r["n"]) for r in out["accuracy"].collect()}
    assert sum(n for _, n in acc.values()) == 3 * 90
    gains = out["versus_baseline"].filter("system = 'llama'").collect()
    assert gains and all(r["gain"] == 0.0 for r in gains)
    terms = {r["term"]: r["coef"] for r in out["model"].collect()}
    assert len(terms) == 12 and terms["system[llama]"] == pytest.approx(0.0, abs=1e-6)


def test_conformity_flows(spark):
    data = [(f"{c}-{t}-{i}", c, "charged" if c < "c" else "control", t, "m", f"gen{1 + i % 4}") for c in "abcd" for t in (0.2, 0.8) for i in range(8)]
    responses = spark.createDataFrame(data, "rid string, concept string, concept_type string, temperature double, model string, generation string").withColumn("concept_id", F.col("concept"))
    vectors = responses.select("rid", F.array(F.lit(1.0), (F.hash("rid") % 100) / 100.0).cast("array<float>").alias("embedding"))
    prototypes = spark.createDataFrame([(c, [1.0, 0.5]) for c in "abc"], "concept_id string, prototype array<double>")
    out = ex.conformity_analysis(responses, vectors, prototypes, "rid")
    assert out["conformity"].count() == 48
    assert rows(out["uncovered"]) == [("d", 16)]
    assert [r["n"] for r in out["ranking"].collect()] == [8, 8, 8]
    assert out["model"].count() == 4
    five = ex.diachronic_analysis(
        responses.withColumn("concept_type", F.when(F.col("concept") < "c", "changing").otherwise("stable")), vectors, prototypes.withColumnRenamed("concept_id", "concept"), "rid"
    )
    assert five["trajectory"].count() == 8
    assert {r["term"] for r in five["model"].collect()} == {"Intercept", "generation_ord", "changing", "generation_ord:changing"}


def test_quality_and_effort_flows(spark):
    def reply(q):
        return json.dumps({"factual_accuracy": q, "practical_actionability": q, "domain_precision": min(q + 1, 5), "brief_justification": "x"})

    data = []
    for i, d in enumerate(["landlord_tenant", "rental_review", "financial_instrument", "cover_letter"]):
        for k in range(64):
            c = k % 16
            level = k % 4
            data.append((d, "high" if i != 1 else "standard", level, bool(c & 1), bool(c & 2), bool(c & 4), bool(c & 8), reply(1 + (level + k % 2 + i) % 5)))
    data.append(("cover_letter", "standard", 0, False, False, False, False, "oops"))
    df = spark.createDataFrame(data, "domain string, complexity string, level int, D boolean, R boolean, V boolean, C boolean, reply string")
    out = ex.quality_analysis(df)
    assert out["scores"].count() == 256 and out["quarantine"].count() == 1
    assert out["curves"].count() == 16
    assert out["attribution"].count() == 11
    assert out["component_ranking"].count() == 4
    assert out["monotonicity"].first()["n"] == 16
    assert out["model"].count() == 4
    users = spark.createDataFrame([(float(60 + 7 * i % 50), i % 6, 1 + i % 7, 1.0 + i % 5, 1 + i % 4, float(i % 2)) for i in range(40)], schemas.USER_STUDY)
    effort = ex.effort_analysis(users)
    assert effort["ratios"].count() == 40
    assert -1 <= effort["inequality"].first()["r"] <= 1
    with pytest.raises(ValueError, match="n_edits"):
        ex.effort_analysis(users.drop("n_edits"))


def test_entropy_and_cluster_flows(spark):
    topics = spark.createDataFrame(
        [(f"c{c}", "charged", "m", 0.8, (i * (c + 2)) % (c + 2)) for c in range(6) for i in range(60)], "concept_id string, concept_type string, model string, temperature double, topic int"
    )
    out = ex.entropy_analysis(topics)
    assert out["entropy"].count() == 18
    assert out["stability"].count() == 3
    data = [(f"r{i}", "m", "high", f"t{i % 3}", f"p{i % 5}", i % 5 > 2, [float((i * 7) % 11), float((i * 5) % 13), float(i % 3)]) for i in range(60)]
    responses = spark.createDataFrame([d[:6] for d in data], "rid string, model string, ambiguity_stratum string, term string, prompt_key string, is_paraphrase boolean")
    vectors = spark.createDataFrame([(d[0], d[6]) for d in data], "rid string, embedding array<float>")
    flow = ex.cluster_analysis(responses, {"a": vectors, "b": vectors}, "rid", {"a": 3, "b": 3})
    assert flow["silhouette"].count() == 2
    assert flow["by_stratum"].first()["n_combinations"] == 2
    assert flow["stability_context"].count() == 2


# --- streams ----------------------------------------------------------------

CALLS = "ts timestamp, model string, tokens bigint, prompt_hash string, temperature double, response_index int"


def at(minute):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute)


def deliver(spark, folder, calls):
    spark.createDataFrame(calls, CALLS).coalesce(1).write.mode("append").json(str(folder))


def run(spark, tmp_path, make):
    stream = st.read_calls(spark, str(tmp_path / "in"), spark.createDataFrame([], CALLS).schema)
    st.append_to(make(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()


def test_monitor_drops_late_records(spark, tmp_path):
    def totals(stream):
        return st.call_totals(stream, F.col("tokens"))

    deliver(spark, tmp_path / "in", [(at(1), "a", 5, "h", 0.0, 0), (at(9), "a", 6, "h", 0.0, 1), (at(300), "a", 1, "h", 0.0, 2)])
    run(spark, tmp_path, totals)
    deliver(spark, tmp_path / "in", [(at(2), "a", 100, "h", 0.0, 3), (at(500), "a", 1, "h", 0.0, 4)])
    run(spark, tmp_path, totals)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert [(r["window_start"], r["n_calls"], r["n_tokens"]) for r in got.orderBy("window_start").collect()] == [(at(0), 2, 11), (at(300), 1, 1)]


def test_redelivered_calls_across_batches(spark, tmp_path):
    calls = [(at(i), "a", 1, f"h{i}", 0.0, 0) for i in range(5)]
    deliver(spark, tmp_path / "in", calls + calls[:2])
    run(spark, tmp_path, st.drop_redelivered)
    deliver(spark, tmp_path / "in", calls[3:] + [(at(6), "a", 1, "h6", 0.0, 0)])
    run(spark, tmp_path, st.drop_redelivered)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    batch = spark.createDataFrame(calls + calls, CALLS)
    assert st.drop_redelivered(batch).count() == 5


def test_copies_are_recognised_after_a_day_and_after_restarts(spark, tmp_path):
    """Late copies, restarts from the same and from a lost checkpoint, replays and null keys store each call once."""
    calls = [(at(i), "a", 1, f"h{i}", 0.0, 0) for i in range(5)] + [(at(0), None, 1, None, None, 0)] * 2
    day_later = [(at(1440), *c[1:]) for c in calls]

    def go(run):
        stream = st.read_calls(spark, str(tmp_path / "in"), spark.createDataFrame([], CALLS).schema)
        st.append_new(stream, str(tmp_path / "out"), str(tmp_path / f"state-{run}"), run).awaitTermination()
        return sorted((str(r["prompt_hash"]), r["ts"]) for r in st.stored_calls(spark, str(tmp_path / "out")).collect())

    deliver(spark, tmp_path / "in", calls)
    first = go("one")
    assert len(first) == 6
    deliver(spark, tmp_path / "in", day_later + [(at(1441), "a", 1, "new", 0.0, 0)])
    want = sorted([*first, ("new", at(1441))])
    assert go("one") == want
    assert go("two") == want
    write = st.new_calls_writer(str(tmp_path / "out"), "one")
    write(spark.createDataFrame(calls, CALLS), 0)
    write(spark.createDataFrame([], CALLS), 2)
    one = spark.read.parquet(str(tmp_path / "out" / "delivery=one-1"))
    plan = st._stored_already(one, str(tmp_path / "out"), "one-1", st.CALL_KEY)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted((str(r["prompt_hash"]), r["ts"]) for r in st.stored_calls(spark, str(tmp_path / "out")).collect()) == want


def test_replayed_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "sums")
    write = st.batch_writer(path, ["model"], "tokens")
    first = spark.createDataFrame([(at(0), "a", 4, "h", 0.0, 0), (at(0), "b", None, "h", 0.0, 1)], CALLS)
    second = spark.createDataFrame([(at(1), "a", 8, "h", 0.0, 0)], CALLS)
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        write(batch, number)
    got = rows(st.accumulated_means(spark, path, ["model"]), "model")
    assert got == [("a", 6.0, 2), ("b", None, 0)]


def test_compaction_keeps_means_and_few_folders(spark, tmp_path, monkeypatch):
    """Replays and a crash between merging and the manifest change nothing; folders grow with the logarithm of the batches."""
    monkeypatch.setattr(st, "FAN", 3)
    path = str(tmp_path / "sums")
    write = st.batch_writer(path, ["model"], "tokens")
    batch = lambda i: spark.createDataFrame([(at(i), "ab"[i % 2], i, "h", 0.0, i)], CALLS).coalesce(1)
    publish = st._publish

    def crash(*args):
        raise OSError("lost")

    for i in range(14):
        if i in (2, 8, 11):
            monkeypatch.setattr(st, "_publish", crash)
            with pytest.raises(OSError):
                write(batch(i), i)
            monkeypatch.setattr(st, "_publish", publish)
        write(batch(i), i)
        if i in (5, 8):
            for again in (0, i - 1, i):
                write(batch(again), again)
        got = rows(st.accumulated_means(spark, path, ["model"]), "model")
        want = {m: [j for j in range(i + 1) if "ab"[j % 2] == m] for m in "ab"}
        assert got == [(m, sum(x) / len(x), len(x)) for m, x in want.items() if x]
    newest = st.manifests(spark, path)
    assert len(newest) <= 2
    entries = newest[max(newest)]
    assert [(first, last) for _, first, last, _ in entries] == [(0, 8), (9, 11), (12, 12), (13, 13)]
    kept = [p.name for p in (tmp_path / "sums").iterdir() if p.is_dir() and p.name != "manifest"]
    assert {e[0] for e in entries} <= set(kept) and len(kept) <= 2 * 3 + 3
