"""Answer dataflow around a model whose answers come as data: gates, packing, markers, pools."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import prompt_token_estimate
from tarnfield.scratch import scratch

SCORE_GATE, MARGIN, POOL_CAP, ROUNDS = 0.30, 64, 15, 3
PREMISE_CHARS, HYPOTHESIS_CHARS, HYPOTHESIS_TOKENS = 1600, (1200, 600, 300, 150), 256
MARKER = r"\[#(\d{1,3})\]"


def effective_k(k: Column, default_k: int = 10) -> Column:
    return F.greatest(k, F.lit(default_k))


def gate(queries: DataFrame, hits: DataFrame, threshold: float = SCORE_GATE) -> DataFrame:
    """query_id, top_score, refusal (no_chunks, score_gate, null), candidates (the first three chunks where the gate refuses)."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("top_score"), F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "chunk_id")))), 1, 3).alias("c"))
    refusal = F.when(F.col("top_score").isNull(), "no_chunks").when(F.col("top_score") < threshold, "score_gate")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", "top_score", refusal.alias("refusal"), F.when(refusal == "score_gate", F.transform("c", lambda x: x["chunk_id"])).alias("candidates"))


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """Hits (query_id, rank, text, source, trust, doc, heading, span) with marker, block and running tokens, up to the budget; the first always stays."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    head = F.concat(F.lit("[#"), n.cast("string"), F.lit("] source="), F.col("source"), F.lit(" trust="), F.coalesce("trust", F.lit("unknown")), F.lit(" doc="), F.col("doc"), F.lit(" heading="), F.coalesce("heading", F.lit("")), F.lit(" span="), F.coalesce("span", F.lit("")))
    packed = hits.withColumn("marker", n).withColumn("block", F.concat(head, F.lit("\n"), F.col("text")))
    used = F.sum(prompt_token_estimate(F.col("block"))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return packed.withColumn("used_tokens", used).where((F.col("marker") == 1) | (F.col("used_tokens") <= budget))


def context_budget(cap: int, system: int, query: int) -> int:
    return cap - (system + query + MARGIN)


def completion_budget(context: Column, used: Column) -> Column:
    return F.greatest(F.lit(64), context - used - 256)


def cited(answer: Column) -> Column:
    """Distinct markers of an answer in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1)), lambda m: m.cast("int")))


def verdict(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """Answers (query_id, answer, cancelled) with cited, unknown, grounded, refusal and citations (chunk ids in pack order)."""
    known = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("marker", "chunk_id"))).alias("known"))
    j = answers.join(known, "query_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<marker:int,chunk_id:string>>")))
    j = j.withColumn("cited", cited(F.coalesce("answer", F.lit(""))))
    j = j.withColumn("unknown", F.array_except("cited", F.transform("known", lambda k: k["marker"])))
    grounded = (F.trim(F.coalesce("answer", F.lit(""))) != "") & (F.size("cited") > 0) & (F.size("unknown") == 0) & ~F.col("cancelled")
    refusal = F.when(F.col("cancelled"), "stream_aborted").when(~grounded, "self_judge")
    own = F.transform(F.filter("known", lambda k: F.array_contains("cited", k["marker"])), lambda k: k["chunk_id"])
    return j.select("query_id", "answer", "cited", "unknown", grounded.alias("grounded"), refusal.alias("refusal"), own.alias("citations"))


def parse_questions(reply: Column, most: int = 10) -> Column:
    """Sub-questions of a JSON array reply, code fences aside; null if there are none."""
    body = F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*|\s*```$", "")
    got = F.slice(F.filter(F.transform(F.from_json(body, "array<string>"), lambda q: F.trim(q)), lambda q: q != ""), 1, most)
    return F.when(F.size(got) > 0, got)


def pool(hits: DataFrame, cap: int = POOL_CAP) -> DataFrame:
    """Hits (query_id, sub_q, rank, chunk_id, …): each chunk once by sub-question order, at most ``cap`` for a query."""
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("sub_q", "rank"))).where("_n = 1").drop("_n")
    return once.withColumn("pool_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("sub_q", "rank", "chunk_id"))).where(F.col("pool_rank") <= cap)


def entailment(logits: Column) -> Column:
    """Softmax share of the first of three logits."""
    top = F.array_max(logits)
    return F.exp(F.element_at(logits, 1) - top) / F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))


def nli_premise(context: Column) -> Column:
    """The packed context as far as the entailment model reads it."""
    return F.substring(context, 1, PREMISE_CHARS)


def nli_hypothesis(answer: Column, tokens: Callable[[Column], Column] = prompt_token_estimate) -> Column:
    """The longest beginning of an answer, of 1200, 600, 300 or 150 characters, that has at most 256 tokens; null if none has."""
    out = F
    for n in HYPOTHESIS_CHARS:
        out = out.when(tokens(F.substring(answer, 1, n)) <= HYPOTHESIS_TOKENS, F.substring(answer, 1, n))
    return out.otherwise(F.lit(None).cast("string"))


def nli_gate(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows with logits (null: the check failed): entail, passed and refusal; failures refuse, and a threshold of 0 asks nothing."""
    e = entailment(F.col("logits"))
    passed = F.lit(True) if threshold <= 0 else F.coalesce(e >= threshold, F.lit(False))
    refusal = F.lit(None).cast("string") if threshold <= 0 else F.when(e.isNull(), "nli_model_unavailable").when(e < threshold, "nli_verification")
    return rows.withColumn("entail", e).withColumn("passed", passed).withColumn("refusal", refusal)


# several hops ----------------------------------------------------------------------------------
HOP = "query_id string, iter int, kind string, sub_queries array<string>, chunks_added int, forced_stop boolean"


def multihop(queries: DataFrame, find: Callable[[DataFrame], DataFrame], decompose: DataFrame, decide: Callable[[DataFrame, int], DataFrame], cap: int = POOL_CAP, rounds: int = ROUNDS, threshold: float = SCORE_GATE) -> dict[str, DataFrame]:
    """Retrieval in rounds for all queries (query_id, text) at once: pool, hops, refusals.

    ``find`` takes (query_id, text) and returns hits (query_id, chunk_id, rank, score, …).
    The model's replies are data: ``decompose`` (query_id, reply) once, ``decide`` for each
    round from (query_id, text, preview) of the queries that go on.

    The original query is asked first, and where it finds nothing or nothing above the gate
    the query is refused. Then each round asks the sub-queries of the last reply and adds
    the chunks that are new, in order, up to ``cap``. A query ends when its reply has no
    further sub-queries (an unreadable one counts as none), and is forced to at the cap or
    in the last round. At the end the gate holds for the pool's first chunk. Each round is
    one search; what it leaves is written to the shared folder.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "text")
    probe = gate(asked, find(asked), threshold).select("query_id", "refusal")
    replies = decompose.select(F.col("query_id").cast("string").alias("query_id"), parse_questions(F.col("reply")).alias("subs"))
    state = scratch(asked.join(probe, "query_id").join(replies, "query_id", "left").withColumn("refusal", F.coalesce("refusal", F.when(F.col("subs").isNull(), "decompose_failed"))), "hops-start")
    refusals = [state.where("refusal is not null").select("query_id", "refusal")]
    going = state.where("refusal is null").select("query_id", "text", "subs")
    hops = going.select("query_id", F.lit(0).alias("iter"), F.lit("decompose").alias("kind"), F.col("subs").alias("sub_queries"), F.lit(0).alias("chunks_added"), F.lit(False).alias("forced_stop"))
    held, pools = None, None
    for no in range(1, rounds + 1):
        subs = going.select("query_id", F.posexplode("subs").alias("sub_no", "text"))
        keyed = subs.select(F.to_json(F.struct("query_id", "sub_no")).alias("query_id"), "text")
        key = F.from_json("query_id", "query_id string, sub_no int")
        hits = find(keyed).withColumn("_k", key).withColumns({"query_id": F.col("_k.query_id"), "sub_q": F.lit(no * 1000) + F.col("_k.sub_no")}).drop("_k")
        kept = hits.select(*[c for c in hits.columns if c != "pool_rank"])
        every = kept if held is None else held.drop("pool_rank").unionByName(kept)
        once = pool(every, cap + 1)
        # one more than the cap is looked for: it tells that the pool is full
        full = scratch(once, "hops-pool")
        added = full.where(F.col("pool_rank") <= cap).groupBy("query_id").agg(F.count_if(F.col("sub_q") >= no * 1000).cast("int").alias("chunks_added"), F.count(F.lit(1)).alias("n_pool"))
        over = full.where(F.col("pool_rank") > cap).select("query_id", F.lit(True).alias("over")).distinct()
        held = full.where(F.col("pool_rank") <= cap)
        told = going.join(added, "query_id", "left").join(over, "query_id", "left").withColumns({"chunks_added": F.coalesce("chunks_added", F.lit(0)), "n_pool": F.coalesce("n_pool", F.lit(0)), "forced_stop": F.lit(no >= rounds) | F.coalesce("over", F.lit(False))})
        open_ = told.where(~F.col("forced_stop") & (F.col("n_pool") > 0)).select("query_id", "text")
        text = F.col("snippet") if "snippet" in held.columns else F.col("chunk_id")
        previews = held.join(open_, "query_id", "left_semi").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pool_rank", text.alias("t")))), lambda x: F.concat(F.lit("["), x["pool_rank"].cast("string"), F.lit("] "), x["t"])), "\n\n").alias("preview"))
        decided = decide(open_.join(previews, "query_id"), no).select(F.col("query_id").cast("string").alias("query_id"), parse_questions(F.col("reply")).alias("new")) if no < rounds else None
        told = told.join(decided, "query_id", "left") if decided is not None else told.withColumn("new", F.lit(None).cast("array<string>"))
        new = F.when(F.col("forced_stop") | (F.col("n_pool") == 0), F.lit(None).cast("array<string>")).otherwise(F.col("new"))
        told = scratch(told.withColumn("new", new).select("query_id", "text", "chunks_added", "forced_stop", "new"), "hops-round")
        hops = hops.unionByName(told.select("query_id", F.lit(no).alias("iter"), F.lit("decide").alias("kind"), F.coalesce("new", F.array().cast("array<string>")).alias("sub_queries"), "chunks_added", "forced_stop"))
        going = told.where("new is not null").select("query_id", "text", F.col("new").alias("subs"))
        ended = told.where("new is null").select("query_id")
        done = held.join(ended, "query_id", "left_semi")
        pools = done if pools is None else pools.unionByName(done)
        held = held.join(going.select("query_id"), "query_id", "left_semi")
        if going.isEmpty():
            break
    first = pools.where("pool_rank = 1").select("query_id", "score")
    last = state.where("refusal is null").select("query_id").join(first, "query_id", "left")
    refusals.append(last.select("query_id", F.when(F.col("score").isNull(), "no_chunks").when(F.col("score") < threshold, "score_gate").alias("refusal")).where("refusal is not null"))
    return {"pool": pools, "hops": hops, "refusals": refusals[0].unionByName(refusals[1])}


def answer_rows(verdicts: DataFrame, queries: DataFrame, now: datetime, **settings: str | float | int | None) -> DataFrame:
    """Rows for the table of answers: trace_id, query and answer with what ``verdict`` says and the settings of the run."""
    rows = queries.select("query_id", F.col("text").alias("query")).join(verdicts, "query_id")
    trace = F.substring(F.sha2(F.concat_ws("\x1f", F.col("query_id").cast("string"), "query", F.coalesce("answer", F.lit("")), F.lit(now.isoformat())), 256), 1, 32)
    return rows.select(trace.alias("trace_id"), "query_id", "query", "answer", "grounded", "refusal", "citations", *[F.lit(v).alias(k) for k, v in settings.items()], F.lit(now).alias("created_at"))
