"""Context assembly: earlier turns, planner and summary replies, sources, index lines."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as tx

# History length, intents, summary questions, expansion budget, the index header.
HISTORY_TURNS = 4
INTENTS = ("lookup", "explain", "enumerate")
QUESTIONS = 4
EXPAND_TOKENS = 4_000
INDEX_HEADER = "Other code that may be relevant, not provided in full (path :: symbol — signature):"


def recent_turns(query_log: DataFrame, *, n: int = HISTORY_TURNS) -> DataFrame:
    """The last `n` answered turns of each conversation; `turn` counts from 1, oldest first.

    The limited row_number runs before the shuffle, so a conversation of any length costs `n`
    rows per task.
    """
    key = ["repo_id", "conversation_id"]
    newest = Window.partitionBy(*key).orderBy(F.desc("id"))
    return (
        query_log.filter("answer IS NOT NULL")
        .withColumn("back", F.row_number().over(newest))
        .filter(F.col("back") <= n)
        .withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
        .drop("back")
    )


# ── Replies ───────────────────────────────────────────────────────────────────


def _json(reply: Column) -> Column:
    """A reply as a variant; null when it is not JSON."""
    return F.try_parse_json(reply)


def _member(data: Column, name: str) -> Column:
    """A member of a JSON object as a variant."""
    return F.try_variant_get(data, f"$.{name}", "variant")


def _type(value: Column) -> Column:
    """The JSON type of a variant, in the words of `schema_of_variant`; null when missing."""
    return F.schema_of_variant(value)


def _string(value: Column) -> Column:
    """A variant as a trimmed string when it is a JSON string with some text, else null."""
    text = tx.strip(F.try_variant_get(value, "$", "string"))
    return F.when((_type(value) == "STRING") & (text != ""), text)


def validate_plans(replies: DataFrame) -> DataFrame:
    """Planner replies (query_id, question, reply) as plans: query, identifiers, intent, planner.

    A reply with a blank query, identifiers that are not all strings, or an unknown intent falls
    back to the question itself, no identifiers and the intent to explain.
    """
    data = replies.withColumn("data", _json(F.col("reply")))
    names = _member(F.col("data"), "identifiers")
    listed = F.try_variant_get(names, "$", "array<string>")
    rows = data.select(
        "query_id",
        "question",
        _string(_member(F.col("data"), "query")).alias("planned"),
        F.when(_type(names).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~_has_null(listed), listed)
        .alias("names"),
        F.when(
            _type(_member(F.col("data"), "intent")) == "STRING",
            F.try_variant_get(F.col("data"), "$.intent", "string"),
        ).alias("wanted"),
    )
    valid = (
        F.col("planned").isNotNull() & F.col("names").isNotNull() & F.col("wanted").isin(*INTENTS)
    )
    ok = F.coalesce(valid, F.lit(False))
    kept = F.filter(F.transform("names", tx.strip), lambda x: x != "")
    return rows.select(
        "query_id",
        F.when(ok, F.col("planned")).otherwise(F.col("question")).alias("query"),
        F.when(ok, kept).otherwise(F.array().cast("array<string>")).alias("identifiers"),
        F.when(ok, F.col("wanted")).otherwise("explain").alias("intent"),
        F.when(ok, "ok").otherwise("fallback").alias("planner"),
    )


def _has_null(items: Column) -> Column:
    """True when an array has a null member (a JSON null among strings)."""
    return F.exists(items, lambda x: x.isNull())


def validate_summaries(replies: DataFrame, *, questions: int = QUESTIONS) -> DataFrame:
    """Summary replies (repo_id, reply) that have a summary and enough questions, the questions
    cut to that many; the others are dropped."""
    data = replies.withColumn("data", _json(F.col("reply")))
    listed = _member(F.col("data"), "questions")
    asked = F.transform(
        F.try_variant_get(F.when(_type(listed).startswith("ARRAY"), listed), "$", "array<variant>"),
        _string,
    )
    kept = F.filter(asked, lambda q: q.isNotNull())
    return (
        data.withColumn("summary", _string(_member(F.col("data"), "summary")))
        .withColumn("suggested_questions", kept)
        .filter(F.col("summary").isNotNull() & (F.size("suggested_questions") >= questions))
        .select(
            "repo_id", "summary", F.slice("suggested_questions", 1, questions)
            .alias("suggested_questions"),
        )
    )


# ── Sources ───────────────────────────────────────────────────────────────────


def part_runs(parts: DataFrame) -> DataFrame:
    """Parts of each hit's symbol with the run they belong to: a run starts at every part 1, so a
    getter and a setter of one name are two runs. The parts of one symbol come from one file."""
    order = Window.partitionBy("query_id", "hit_chunk_id").orderBy(
        "start_line", "part", "chunk_id"
    )
    starts = F.sum(F.when(F.col("part") == 1, 1).otherwise(0))
    return parts.withColumn("run", starts.over(order).cast("int"))


def grown(run: Column, at: Column, budget: int) -> Column:
    """(lo, hi) around position `at` of a run of (chunk_id, tokens): grown by the part after, then
    the part before, and again, while the tokens fit; a round that adds neither changes nothing."""
    state = F.struct(
        at.alias("lo"), at.alias("hi"), F.get(run, at)["tokens"].cast("long").alias("used")
    )

    def tokens(i: Column) -> Column:
        return F.when(i >= 0, F.get(run, F.greatest(i, F.lit(0)))["tokens"])

    def after(acc: Column) -> Column:
        more = tokens(acc["hi"] + 1)
        fits = F.coalesce(acc["used"] + more <= budget, F.lit(False))
        return F.when(
            fits,
            F.struct(
                acc["lo"].alias("lo"),
                (acc["hi"] + 1).alias("hi"),
                (acc["used"] + more).alias("used"),
            ),
        ).otherwise(acc)

    def before(acc: Column) -> Column:
        more = tokens(acc["lo"] - 1)
        fits = F.coalesce(acc["used"] + more <= budget, F.lit(False))
        return F.when(
            fits,
            F.struct(
                (acc["lo"] - 1).alias("lo"),
                acc["hi"].alias("hi"),
                (acc["used"] + more).alias("used"),
            ),
        ).otherwise(acc)

    rounds = F.sequence(F.lit(1), F.size(run))
    return F.aggregate(rounds, state, lambda acc, _: tx.let(after(acc), before))


def expand_top(top: DataFrame, runs: DataFrame, *, budget: int = EXPAND_TOKENS) -> DataFrame:
    """The blocks of each query's top hit (query_id, chunk_id): the parts of its run around it
    that fit the budget, or the hit alone: query_id, hit_chunk_id, block from 0, chunk_id."""
    hit = top.select("query_id", F.col("chunk_id").alias("hit_chunk_id"))
    members = F.transform(
        F.array_sort(F.collect_list(F.struct("start_line", "part", "chunk_id", "tokens"))),
        lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["tokens"].alias("tokens")),
    )
    own = (
        runs.groupBy("query_id", "hit_chunk_id", "run")
        .agg(members.alias("members"))
        .withColumn(
            "at",
            F.array_position(
                F.transform("members", lambda x: x["chunk_id"]), F.col("hit_chunk_id")
            ).cast("int")
            - 1,
        )
        .filter((F.col("at") >= 0) & (F.size("members") > 1))
        .withColumn("span", grown(F.col("members"), F.col("at"), budget))
        .select(
            "query_id",
            "hit_chunk_id",
            F.transform(
                F.slice("members", F.col("span.lo") + 1, F.col("span.hi") - F.col("span.lo") + 1),
                lambda x: x["chunk_id"],
            ).alias("blocks"),
        )
    )
    alone = F.array("hit_chunk_id")
    return hit.join(own, ["query_id", "hit_chunk_id"], "left").select(
        "query_id", "hit_chunk_id", F.posexplode_outer(F.coalesce("blocks", alone)).alias("block", "chunk_id")
    )


def brief_sources(blocks: DataFrame) -> DataFrame:
    """Sources as an answer sees them, from block rows (query_id, rank, block, place, tier, text,
    commit_sha): one per rank, its key `path:start-end` (the bare path for a module)."""
    first = F.element_at("rows", 1)
    last = F.element_at("rows", -1)
    lines = F.concat(
        F.lit(":"), first["start_line"].cast("string"), F.lit("-"), last["end_line"].cast("string")
    )
    whole = first["kind"] == "module"
    fields = (
        "block", "path", "kind", "name", "qualname", "tier", "text", "start_line", "end_line",
        "commit_sha",
    )
    grouped = blocks.groupBy("query_id", "rank").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("rows")
    )
    return grouped.select(
        "query_id",
        "rank",
        F.concat(first["path"], F.when(whole, F.lit("")).otherwise(lines)).alias("source"),
        F.coalesce(tx.label(first["name"], first["qualname"]), first["path"]).alias("title"),
        F.transform(
            "rows",
            lambda r: F.struct(
                r["text"].alias("text"),
                r["start_line"].alias("start_line"),
                r["end_line"].alias("end_line"),
            ),
        ).alias("blocks"),
        first["path"].alias("path"),
        first["kind"].alias("kind"),
        first["qualname"].alias("qualname"),
        F.get(F.filter("rows", lambda r: r["tier"].isNotNull()), F.lit(0))["tier"].alias("tier"),
        first["commit_sha"].alias("commit_sha"),
    )


def replay_dedup(history: DataFrame, current: DataFrame) -> DataFrame:
    """Sources of a request in search-result order (`index` from 0): those cited in earlier turns
    (query_id, turn, pos, source, ...), then this turn's (query_id, pos, source, ...) that were
    not among them."""
    fresh = current.join(history.select("query_id", "source"), ["query_id", "source"], "left_anti")
    never = F.lit(None).cast("int")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("turn"), "pos")
    columns = ["query_id", "turn", "pos", *[c for c in current.columns if c not in ("query_id", "pos")]]
    return (
        history.select(*columns)
        .unionByName(fresh.withColumn("turn", never).select(*columns))
        .withColumn("index", F.row_number().over(order) - 1)
    )


def index_lines(hits: DataFrame, *, header: str = INDEX_HEADER) -> DataFrame:
    """One text per query from its index hits (query_id, rank, path, name, qualname, signature):
    a header, then `path :: label — first signature line` per hit, in rank order."""
    label = tx.label(F.col("name"), F.col("qualname"))
    signature = F.nullif(
        F.get(tx.split_lines(tx.strip(F.coalesce("signature", F.lit("")))), F.lit(0)), F.lit("")
    )
    line = F.concat(
        F.col("path"),
        F.coalesce(F.concat(F.lit(" :: "), label), F.lit("")),
        F.coalesce(F.concat(F.lit(" — "), signature), F.lit("")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(
        F.concat_ws(
            "\n", F.lit(header), F.transform(ordered, lambda x: x["line"])
        ).alias("text")
    )
