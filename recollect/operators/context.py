"""Memory text for a prompt and its placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.times import date_tag

# Headings of the memory text.
FACTS, SOURCES = "📌 事实", "📖 溯源原文"
FOOTER = "💡 如需查看更多，可以调 search_memories 或 read_diary 工具。"
SUFFIX, PREFIX_USER, SUFFIX_USER, KNOWLEDGE, MANUAL = (
    "system_prompt_suffix", "user_message_prefix", "user_message_suffix", "knowledge_section", "manual_only")


def _first_person(c: Column, bot_name: str) -> Column:
    for old in (bot_name, "Bot"):
        if old:
            c = F.replace(c, F.lit(old), F.lit("我"))
    return c


def _lines(rows: DataFrame, key: str, order: str, line: Column, name: str) -> DataFrame:
    # a handful of rows per request
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]).alias(name))


def render(queries: DataFrame, ranked: DataFrame, atoms: DataFrame, traced: DataFrame, personas: DataFrame, now: str,
           bot_name: str = "", max_tokens: int = 500) -> DataFrame:
    """``(query_id, memory_text)``: persona line, facts, sources, footer, within the budget of four characters a token."""
    a = ranked.join(atoms.select("atom_id", "atom_type", "diary_date", "content"), "atom_id")
    tag = date_tag(F.coalesce(F.col("diary_date").cast("string"), F.lit("")), now)
    fact = F.concat(F.lit("- ["), F.col("atom_type"), F.lit("]"), F.when(F.length(tag) > 0, F.concat(F.lit(" ["), tag, F.lit("]"))).otherwise(""),
                    F.lit(" "), _first_person(F.substring("content", 1, 200), bot_name))
    fact_lines = _lines(a, "query_id", "rank", fact, "facts")
    src = F.concat(F.lit("- ["), F.col("date").cast("string"), F.lit(" 日记#"), F.col("diary_id").cast("string"), F.lit("] "), _first_person(F.col("snippet"), bot_name))
    src_lines = _lines(traced, "query_id", "pos", src, "sources")
    p = personas.select(F.col("uid").alias("user_id"), "tags", F.col("summary").alias("_s"))
    j = queries.select("query_id", "user_id").join(p, "user_id", "left").join(fact_lines, "query_id", "left").join(src_lines, "query_id", "left")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("标签: "), F.array_join(F.slice("tags", 1, 8), ", ")))
    short = F.trim(F.split(F.substring("_s", 1, 100), "\n")[0])
    note = F.when(F.length(short) > 0, F.concat(F.lit("摘要: "), short))
    persona = F.concat_ws("\n", tags, note)
    none = F.array().cast("array<string>")
    blocks = F.concat(
        F.when(F.length(persona) > 0, F.array(persona)).otherwise(none),
        F.when(F.col("facts").isNotNull(), F.concat(F.array(F.lit(""), F.lit(FACTS)), F.col("facts"))).otherwise(none),
        F.when(F.col("sources").isNotNull(), F.concat(F.array(F.lit(""), F.lit(SOURCES)), F.col("sources"))).otherwise(none),
        F.array(F.lit(""), F.lit(FOOTER)))
    text = F.array_join(blocks, "\n")
    n = max_tokens * 4
    return j.select("query_id", F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text).alias("memory_text"))


def memory_block(memory: Column, user_name: Column, template: str = "", use_tag: bool = True) -> Column:
    if template:
        body = F.replace(F.replace(F.lit(template), F.lit("{{content}}"), memory), F.lit("{{user}}"), user_name)
    else:
        body = F.concat(F.lit("【长期记忆】\n"), memory)
    if use_tag:
        body = F.concat(F.lit("<memory>\n"), body, F.lit("\n</memory>"))
    return F.when(F.length(F.trim(memory)) > 0, body).otherwise(F.lit(""))


def inject(requests: DataFrame, position: str = SUFFIX, template: str = "", use_tag: bool = True) -> DataFrame:
    """``requests(memory_text, persona_text, system_prompt, user_message, user_name)`` with the block in place."""
    if position == MANUAL:
        return requests
    empty = F.lit("")
    persona = F.when(F.length("persona_text") > 0, F.concat(F.lit("关于你：\n"), F.substring("persona_text", 1, 300), F.lit("\n\n"))).otherwise(empty)
    block = memory_block(F.concat(persona, F.coalesce("memory_text", empty)), F.coalesce("user_name", empty), template, use_tag)
    sys, msg = F.coalesce("system_prompt", empty), F.coalesce("user_message", empty)
    gap = F.when((F.length(sys) > 0) & ~sys.endswith("\n"), "\n\n").otherwise("")
    new_sys, new_msg = sys, msg
    if position == SUFFIX:
        new_sys = F.concat(sys, gap, block)
    elif position == PREFIX_USER:
        new_msg = F.concat(block, F.lit("\n\n"), msg)
    elif position == SUFFIX_USER:
        new_msg = F.concat(msg, F.lit("\n\n"), block)
    elif position == KNOWLEDGE:
        new_sys = F.concat(sys, gap, F.lit("[知识库]\n"), block, F.lit("\n[/知识库]"))
    any_ = F.length(block) > 0
    return requests.withColumn("_s", F.when(any_, new_sys).otherwise(sys)).withColumn("_m", F.when(any_, new_msg).otherwise(msg)).withColumn(
        "system_prompt", F.col("_s")).withColumn("user_message", F.col("_m")).drop("_s", "_m")
