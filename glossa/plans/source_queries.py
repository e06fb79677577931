"""Source, sink and streaming queries; they write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as tx
from ..session import shared_dir
from ..sources import files, schemas
from ..streaming import calls as st
from .registry import query, rounded, table, texts


@query(
    "csv_roundtrip",
    """select p_partkey, p_name || chr(10) || '"' || p_brand || '" # ' || p_type as note, p_size, p_retailprice from part""",
)
def csv_roundtrip(spark, sf):
    path = shared_dir(spark, "stimuli")
    note = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('" # '), "p_type").alias("note")
    files.write_csv(table(spark, sf, "part").select("p_partkey", note, "p_size", "p_retailprice"), path)
    return files.read_stimuli(spark, path, "p_partkey bigint, note string, p_size int, p_retailprice double")


@query("jsonl_roundtrip", "select conv_id, turn, role, text from conversations")
def jsonl_roundtrip(spark, sf):
    path = shared_dir(spark, "records")
    conversations = table(spark, sf, "conversations")
    files.write_jsonl(conversations, path)
    return files.read_jsonl(spark, path, conversations.schema)


@query("call_log", "select event_id, event_type as model, value from events")
def call_log(spark, sf):
    path = shared_dir(spark, "calls")
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), "value")
    files.append_calls(events.filter("value < 20"), path)
    files.append_calls(events.filter("value >= 20 or value is null"), path)
    return spark.read.schema("event_id bigint, model string, value double").json(path)


@query(
    "vectors_roundtrip",
    "select vec_id, label, len(embedding) as dim, round(list_sum(embedding::double[]), 6) as total from embeddings",
)
def vectors_roundtrip(spark, sf):
    path = shared_dir(spark, "vectors")
    vectors = table(spark, sf, "embeddings")
    files.write_vectors(vectors, path)
    back = files.read_vectors(spark, path, vectors.schema)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rounded(back.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dim"), total.alias("total")))


@query(
    "response_slice",
    "select l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag as model, l_tax as temperature from lineitem where l_returnflag = 'R' and l_tax = 0.08",
)
def response_slice(spark, sf):
    path = shared_dir(spark, "responses")
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_returnflag").alias("model"), F.col("l_tax").alias("temperature")
    )
    files.write_responses(line, path)
    return spark.read.schema(line.schema).parquet(path).filter("model = 'R' and temperature = 0.08")


@query(
    "paragraphs",
    r"""with l as (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g') as paragraph,
                  unnest(range(len(string_split(text, chr(10))))) as pos from documents),
        k as (select doc_id, row_number() over (partition by doc_id order by pos) - 1 as para_index, paragraph from l where length(paragraph) > 80)
        select doc_id, para_index::int as para_index, md5(paragraph) as digest, length(paragraph)::int as n_chars from k where para_index < 50""",
)
def paragraphs(spark, sf):
    kept = files.paragraphs(texts(spark, sf), "text", "doc_id")
    return kept.select("doc_id", "para_index", F.md5("paragraph").alias("digest"), F.length("paragraph").alias("n_chars"))


@query(
    "text_len",
    "select doc_id, case when length(text) > 0 then length(text) end::int as intro_length, (doc_id % 4)::int as n_revisions from documents",
)
def text_len(spark, sf):
    revisions = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 4), lambda i: F.struct(i.alias("revid")))
    page = F.struct(
        F.col("source").alias("title"),
        F.col("text").alias("extract"),
        F.when(F.col("doc_id") % 4 > 0, F.slice(revisions, F.lit(1), (F.col("doc_id") % 4).cast("int"))).alias("revisions"),
    )
    reply = F.to_json(F.struct(F.struct(F.create_map(F.col("doc_id").cast("string"), page).alias("pages")).alias("query")))
    replies = table(spark, sf, "documents").select("doc_id", reply.alias("reply"))
    return files.page_measures(files.stored_pages(replies, "reply", schemas.PAGE_REPLY, "doc_id"), "doc_id")


_SCORE = StructType([StructField("k", IntegerType())])


def _scored(spark, sf):
    # Replies of error events are cut short, and those of views name another field.
    cut = F.expr("substring(props, 1, length(props) - 1)")
    other = F.replace("props", F.lit('"k"'), F.lit('"j"'))
    reply = F.when(F.col("event_type") == "error", cut).when(F.col("event_type") == "view", other).otherwise(F.col("props"))
    replies = table(spark, sf, "events").select("event_id", "event_type", reply.alias("reply"))
    return files.parse_scores(replies, "reply", _SCORE, ["k"])


@query(
    "json_scores",
    "select event_id, event_type, (props->>'$.k')::int as k from events where event_type not in ('error', 'view')",
)
def json_scores(spark, sf):
    good, _ = files.split_scores(_scored(spark, sf))
    return good.drop("reply")


@query("json_quarantine", "select event_type, count(*) as n from events where event_type in ('error', 'view') group by 1")
def json_quarantine(spark, sf):
    _, bad = files.split_scores(_scored(spark, sf))
    return bad.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# --- streams ----------------------------------------------------------------


def _event_stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return st.read_calls(spark, sf, schema, "parquet", pathGlobFilter=f"{name}.parquet")


def _calls(events):
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        tx.prompt_hash(F.concat_ws("|", F.col("event_id").cast("string"), "props")).alias("prompt_hash"),
        F.col("value").alias("temperature"),
        F.col("event_id").alias("response_index"),
    )


_WINDOWS = """w as (select time_bucket(interval '10 minutes', ts) as window_start, time_bucket(interval '10 minutes', ts) + interval '10 minutes' as window_end,
    event_type as model, count(*) as n_calls, coalesce(sum((props->>'$.k')::bigint), 0)::bigint as n_tokens from events group by all)"""


@query("call_totals", f"with {_WINDOWS} select strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') as window_end, model, n_calls, n_tokens from w")
def call_totals(spark, sf):
    totals = st.call_totals(_calls(table(spark, sf, "events")), F.col("tokens"))
    return _as_text(totals, "window_start", "window_end")


def _as_text(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


@query(
    "call_monitor",
    f"""with {_WINDOWS} select strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') as window_end, model, n_calls, n_tokens
        from w where window_end <= (select max(ts) - interval '1 hour' from events)""",
)
def call_monitor(spark, sf):
    out, checkpoint = shared_dir(spark, "monitor"), shared_dir(spark, "monitor-state")
    totals = st.call_totals(_calls(_event_stream(spark, sf, "events")), F.col("tokens"))
    st.append_to(totals, out, checkpoint).awaitTermination()
    return _as_text(spark.read.parquet(out), "window_start", "window_end")


@query(
    "call_ingest",
    "select substr(md5(event_id || '|' || props), 1, 8) as prompt_hash, event_type as model, value as temperature, event_id as response_index from events",
)
def call_ingest(spark, sf):
    # Every event is delivered twice.
    out, checkpoint = shared_dir(spark, "ingest"), shared_dir(spark, "ingest-state")
    delivered = _calls(_event_stream(spark, sf, "events")).unionByName(_calls(_event_stream(spark, sf, "events")))
    st.append_to(st.drop_redelivered(delivered), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("prompt_hash", "model", "temperature", "response_index")


@query(
    "call_redelivery",
    """select substr(md5(event_id || '|' || props), 1, 8) as prompt_hash, event_type as model, value as temperature, event_id as response_index,
          strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from events""",
)
def call_redelivery(spark, sf):
    # Every event comes again a day later than it was made, to a stream with a checkpoint of its own.
    out = shared_dir(spark, "redelivery")
    calls = _calls(_event_stream(spark, sf, "events"))
    late = _calls(_event_stream(spark, sf, "events")).withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
    for run, stream in (("first", calls), ("late", late)):
        st.append_new(stream, out, shared_dir(spark, "redelivery-state"), run).awaitTermination()
    stored = st.stored_calls(spark, out).select("prompt_hash", "model", "temperature", "response_index", "ts")
    return _as_text(stored, "ts")


@query(
    "running_accuracy",
    """select l_returnflag as system, l_linestatus as depth, round(avg((l_quantity > 25)::int), 6) as mean, count(*) as n from lineitem group by all""",
)
def running_accuracy(spark, sf):
    out, checkpoint = shared_dir(spark, "running"), shared_dir(spark, "running-state")
    graded = _event_stream(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("depth"), (F.col("l_quantity") > 25).cast("int").alias("correct")
    )
    st.accumulate(graded, out, checkpoint, ["system", "depth"], "correct").awaitTermination()
    return rounded(st.accumulated_means(spark, out, ["system", "depth"]))
