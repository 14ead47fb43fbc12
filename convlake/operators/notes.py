"""Notes as a map-reduce job: lines, budgets, clean items (N)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions.columns import clock, list_item, note_key, parse_time, strip
from convlake.functions.ordered import in_order

# What stands for no owner and no date.
PLACEHOLDERS = ["", "none", "n a", "na", "unknown", "not specified", "not mentioned", "tbd", "unassigned"]


def transcript_lines(segments: DataFrame, names: DataFrame) -> DataFrame:
    """N1. [hh:mm:ss] Who: text of each segment; names has meeting_id, key, name."""
    rows = segments.join(names.withColumnRenamed("key", "speaker"), ["meeting_id", "speaker"], "left")
    return rows.select("meeting_id", "idx", F.concat(F.lit("["), clock("(start_ms div 1000)"), F.lit("] "), F.coalesce("name", "speaker"), F.lit(": "), F.col("text")).alias("line"))


def line_tokens(lines: DataFrame) -> DataFrame:
    """N2. Estimated tokens: length / 3.5 + 2, over 400 characters length / 3.6 + 1, cut to whole numbers."""
    return lines.selectExpr("meeting_id", "idx", "cast(if(length(line) > 400, length(line) * 5 div 18 + 1, length(line) * 2 div 7 + 2) AS bigint) AS tokens")


def plan_parts(tokens: DataFrame, budget: int) -> DataFrame:
    """N3. One part if the meeting fits the budget, else at least two, with an even budget for each."""
    rows = tokens.groupBy("meeting_id").agg(F.sum("tokens").alias("total"))
    parts = f"if(total <= {budget}, 1L, greatest(2L, (total + {budget - 1}) div {budget}))"
    return rows.selectExpr("meeting_id", "total", f"{parts} AS parts").selectExpr("*", f"if(parts = 1, cast({budget} AS bigint), total * 108 div (parts * 100) + 200) AS part_budget")


def dedupe_items(items: DataFrame) -> DataFrame:
    """N8. Of the lines of a meeting that say the same (in a-z and 0-9) the first; bullets go, lines that say nothing too."""
    rows = items.select("meeting_id", "idx", F.expr(list_item("line")).alias("item"))
    rows = rows.withColumn("key", note_key("item")).where("key <> ''")
    return rows.groupBy("meeting_id", "key").agg(F.expr("min_by(struct(idx, item), idx)").alias("s")).selectExpr("meeting_id", "s.idx", "s.item")


def summary_line(texts: DataFrame) -> DataFrame:
    """N16. The first line of a text without white space around it, at most 300 characters."""
    return texts.selectExpr("meeting_id", f"left(split({strip('text')}, '\\n')[0], 300) AS summary")


def clean_actions(actions: DataFrame) -> DataFrame:
    """N9. Tasks (meeting_id, idx, task, owner, due, time, duration_s): of those that say the same the first, one whose
    words hold no a-z and 0-9 too; placeholders for owner and due become empty, times over 5 s past the end null."""

    def filled(name: str) -> Column:
        return F.when(F.coalesce(note_key(name), F.lit("")).isin(PLACEHOLDERS), "").otherwise(F.expr(strip(name))).alias(name)

    rows = actions.select("meeting_id", "idx", F.expr(strip("task")).alias("task"), filled("owner"), filled("due"), parse_time("time").alias("t"), "duration_s")
    rows = rows.where("task <> ''").withColumn("t", F.expr("if(t <= duration_s + 5, t, NULL)")).withColumn("key", note_key("task"))
    first = rows.groupBy("meeting_id", "key").agg(F.expr("min_by(struct(idx, task, owner, due, t), idx)").alias("a"))
    return first.select("meeting_id", "a.*", F.lit(False).alias("done"))


def action_board(actions: DataFrame, show: str = "all", owner: str = "") -> DataFrame:
    """N18. Per meeting with a visible task: its open and done tasks, and the visible ones (all, open or done; of one
    owner) by number."""
    seen = {"all": F.lit(True), "open": ~F.col("done"), "done": F.col("done")}[show] & (F.lit(not owner) | (F.col("owner") == owner))
    board = actions.groupBy("meeting_id").agg(
        F.count_if(~F.col("done")).alias("open"), F.count_if("done").alias("done"), F.count_if(seen).alias("visible"),
        F.array_join(F.array_sort(F.collect_list(F.when(seen, F.col("idx")))), ",").alias("items"),
    )
    return board.where("visible > 0")


def rename_in_notes(texts: DataFrame, renames: DataFrame, columns: list[str]) -> DataFrame:
    """L23. Text columns with each meeting's old names (meeting_id, old, new) as whole words replaced by the new, in order of old.
    Names are taken letter by letter, not as patterns; null and empty old names change nothing."""
    pairs = renames.where("old <> '' AND new IS NOT NULL AND old <> new").groupBy("meeting_id").agg(F.expr("array_sort(collect_set(struct(old, new)))").alias("_pairs"))
    rows = texts.join(pairs, "meeting_id", "left")
    word, quoted = r"[\\p{L}\\p{N}_]", r"concat('\\Q', replace(p.old, '\\E', '\\E\\\\E\\Q'), '\\E')"
    new = r"regexp_replace(p.new, '([\\\\$])', '\\\\$1')"
    swap = f"regexp_replace(t, concat('(?<!{word})', {quoted}, '(?!{word})'), {new})"
    fold = "aggregate(coalesce(_pairs, array()), {c}, (t, p) -> %s)" % swap
    return rows.withColumns({c: F.expr(fold.format(c=c) if "{" not in swap else fold.replace("{c}", c)) for c in columns}).drop("_pairs")


KEPT_ANSWERS = 60
CHAPTER_GAP_S, CHAPTER_NEAR_S, CHAPTER_REACH = 5, 90, 0.6
CONDENSE_ROUNDS = 4


def chunk_lines(tokens: DataFrame, budget: int) -> DataFrame:
    """N4. Parts (meeting_id, part from 0, idx) of the lines (meeting_id, idx, tokens, carried) of each meeting: as many lines as fit
    the budget, and one at least; each part begins with the last line of the one before, which then costs `carried`."""
    kind = tokens.schema["meeting_id"].dataType.simpleString()

    def deal(rows: Iterator[tuple]) -> Iterator[tuple]:
        part, used, last = 0, 0, None
        for meeting, idx, cost, carried in rows:
            if last is not None and used + cost > budget:
                part, used = part + 1, last[1]
                yield meeting, part, last[0]
            yield meeting, part, idx
            used, last = used + cost, (idx, carried)

    return in_order(tokens.select("meeting_id", "idx", "tokens", "carried"), ["meeting_id"], ["idx"], deal, f"meeting_id {kind}, part long, idx long")


def pending_parts(parts: DataFrame, cache: DataFrame, backend: str, model: str) -> tuple[DataFrame, DataFrame]:
    """N5. The parts (meeting_id, part, prompt) whose answer is not known, with their key, and of the known answers (meeting_id, key,
    seq, cut) the newest 60 of each meeting. Answers that were cut off are not kept."""
    keyed = parts.withColumn("key", F.sha1(F.concat_ws("\n", F.lit(backend), F.lit(model), "prompt")))
    whole = cache.where("NOT coalesce(cut, false)")
    kept = whole.selectExpr("*", "row_number() OVER (PARTITION BY meeting_id ORDER BY seq DESC, key) AS place").where(f"place <= {KEPT_ANSWERS}").drop("place")
    return keyed.join(kept.select("meeting_id", "key"), ["meeting_id", "key"], "left_anti"), kept


def map_parts(parts: DataFrame, annotate: Callable[[list[str]], list[str]], partitions: int | None = None) -> DataFrame:
    """N6. The caller's answer to the prompt of each part (meeting_id, part, key, prompt). Parts are dealt over the cluster one by
    one, so a long meeting doesn't wait in one task. A null prompt gets a null answer."""
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}

    def run(batches):
        for batch in batches:
            asked = batch["prompt"].notna()
            batch["answer"] = None
            batch.loc[asked, "answer"] = annotate(batch.loc[asked, "prompt"].tolist())
            yield batch[["meeting_id", "part", "key", "answer"]]

    rows = parts.select("meeting_id", "part", "key", "prompt")
    n = partitions or parts.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n, "meeting_id", "part").mapInPandas(run, f"meeting_id {kinds['meeting_id']}, part {kinds['part']}, key string, answer string")


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def _whole_part(text: str) -> str | None:
    """The longest start of a cut-off object that becomes whole once its brackets are closed."""
    opened, cuts, quoted, skip = [], [], False, False
    for i, ch in enumerate(text):
        if quoted:
            if skip:
                skip = False
            elif ch in '"\\':
                skip, quoted = ch == "\\", ch == "\\"
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            opened.append({"{": "}", "[": "]"}[ch])
        elif ch in "}]," and opened:
            if ch != ",":
                opened.pop()
            cuts.append((i + (ch != ","), "".join(opened[::-1])))
    for end, close in reversed(cuts):
        whole = text[:end] + close
        if _is_object(whole) and json.loads(whole):
            return whole
    return None


def parse_answers(raw: DataFrame, schema: str) -> DataFrame:
    """N7. Answers (text) as structs: ok as they are without reasoning and code fences, or as the outermost braces without trailing
    commas; repaired where a cut-off object was closed behind its last whole value; else bad, with a null struct. Only answers that
    the JVM cannot read go through Python."""

    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None or "{" not in t else _whole_part(t[t.index("{") :]))

    plain = r"regexp_replace(coalesce(text, ''), '(?s)<think>.*?</think>', '')"
    plain = rf"trim(BOTH ' \n\t\r' FROM regexp_replace(split({plain}, '<think>')[0], '^\\s*```(?:json)?\\s*|\\s*```\\s*$', ''))"
    braces = r"regexp_replace(regexp_extract(_plain, '(?s)\\{.*\\}', 0), ',\\s*([}\\]])', '$1')"
    is_json = "(left({c}, 1) = '{{' AND json_object_keys({c}) IS NOT NULL)"
    rows = raw.withColumn("_plain", F.expr(plain)).withColumn("_braces", F.expr(braces))
    rows = rows.withColumn("_ok", F.expr(f"CASE WHEN {is_json.format(c='_plain')} THEN _plain WHEN {is_json.format(c='_braces')} THEN _braces END"))
    good = rows.where("_ok IS NOT NULL").withColumns({"_json": F.col("_ok"), "outcome": F.lit("ok")})
    rest = rows.where("_ok IS NULL").withColumn("_json", repair("_plain")).withColumn("outcome", F.expr("if(_json IS NULL, 'bad', 'repaired')"))
    both = good.unionByName(rest).withColumn("answer", F.from_json("_json", schema))
    return both.drop("_plain", "_braces", "_ok", "_json")


def clean_chapters(chapters: DataFrame) -> DataFrame:
    """N10. Chapters (meeting_id, idx, time, title, summary, duration_s) in order of time, without those that have no title or time
    or lie over 5 s past the end, and without those less than 5 s after, or named as, the last one kept."""
    rows = chapters.select("meeting_id", "idx", parse_time("time").alias("t"), F.expr(strip("title")).alias("title"), F.expr(strip("coalesce(summary, '')")).alias("summary"), "duration_s")
    rows = rows.where("title <> '' AND t <= duration_s + 5").withColumn("key", note_key("title"))
    lists = rows.groupBy("meeting_id").agg(F.expr("array_sort(collect_list(struct(t, idx, title, summary, key)))").alias("c"))
    seen = "size(s) > 0 AND (x.t - element_at(s, -1).t < %d OR x.key = element_at(s, -1).key)" % CHAPTER_GAP_S
    kept = f"aggregate(c, slice(c, 1, 0), (s, x) -> if({seen}, s, concat(s, array(x))))"
    return lists.select("meeting_id", F.explode(F.expr(kept)).alias("k")).select("meeting_id", "k.t", "k.title", "k.summary")


def clean_sections(items: DataFrame) -> DataFrame:
    """N12. Sections (meeting_id, section, title, items) of rows (meeting_id, section, title, idx, item): bullets and repeats go, and
    what has no title or no item left."""
    rows = items.where("title <> ''").select("meeting_id", "section", "title", "idx", F.expr(list_item("item")).alias("item"))
    rows = rows.withColumn("key", note_key("item")).where("key <> ''")
    first = rows.groupBy("meeting_id", "section", "title", "key").agg(F.expr("min_by(struct(idx, item), idx)").alias("s"))
    return first.groupBy("meeting_id", "section", "title").agg(F.expr("transform(array_sort(collect_list(s)), x -> x.item)").alias("items"))


def clean_title(title: str) -> Column:
    """N12. A title without quotes around it, at most 120 characters."""
    bare = f"""trim(BOTH '"' FROM {strip(f"coalesce({title}, '')")})"""
    return F.expr(f"left({strip(bare)}, 120)")


def clean_record(records: DataFrame) -> DataFrame:
    """N12. Whole records (meeting_id, title, summary, and the lists key_points, decisions, open_questions) cleaned: the title, the
    summary without white space around it, and of each list the items that say something, of those that say the same the first.
    Null lists are empty, null items are left out. Tasks, chapters and sections are cleaned by N9, N10 and N12 as rows."""
    key = r"trim(regexp_replace(lower(x), '[^a-z0-9]+', ' '))"

    def items(name: str) -> str:
        told = f"transform(filter(coalesce({name}, array()), x -> x IS NOT NULL), x -> {list_item('x')})"
        keyed = f"filter(transform({told}, x -> struct({key} AS k, x AS item)), y -> y.k <> '')"
        return f"transform(map_entries(aggregate({keyed}, cast(map() AS map<string, string>), (m, y) -> if(map_contains_key(m, y.k), m, map_concat(m, map(y.k, y.item))))), e -> e.value) AS {name}"

    lists = [items(c) for c in ("key_points", "decisions", "open_questions")]
    return records.select("meeting_id", clean_title("title").alias("title"), F.expr(strip("coalesce(summary, '')")).alias("summary"), *map(F.expr, lists))


def chapters_from_topics(topics: DataFrame) -> DataFrame:
    """N13. Of the topics (meeting_id, part, idx, time, title, most, until_s) of all parts that begin before until_s the `most` that
    are evenly spaced in order of time."""
    rows = topics.select("meeting_id", "part", "idx", parse_time("time").alias("t"), F.expr(strip("title")).alias("title"), "most", "until_s").where("t < until_s AND title <> ''")
    rows = rows.selectExpr("*", "row_number() OVER (PARTITION BY meeting_id ORDER BY t, part, idx) - 1 AS place", "count(*) OVER (PARTITION BY meeting_id) AS n")
    near = "cast(round(place * (most - 1D) / greatest(1, n - 1)) AS bigint)"
    hit = f"exists(array(-1, 0, 1), o -> {near} + o BETWEEN 0 AND most - 1 AND bround(({near} + o) * (n - 1) / (most - 1D)) = place)"
    return rows.where(f"n <= most OR most <= 1 OR {hit}").select("meeting_id", "t", "title")


def meeting_chapters(final: DataFrame, topics: DataFrame) -> DataFrame:
    """N14. The chapters (meeting_id, idx, t, title, summary, duration_s) if the last reaches 60 % of the meeting, or if there are no
    topics (meeting_id, t, title, duration_s); else the topics, each with the summary of the first chapter within 90 s that has one."""
    reach = final.groupBy("meeting_id").agg(F.expr(f"max(t >= {CHAPTER_REACH}D * duration_s)").alias("reach"))
    use = topics.select("meeting_id").distinct().join(reach, "meeting_id", "left").where("NOT coalesce(reach, false)").select("meeting_id")
    bin_ = CHAPTER_NEAR_S + 1
    told = final.where("trim(summary) <> ''").selectExpr("meeting_id", "idx", "t AS ct", "trim(summary) AS summary", f"explode(sequence(t div {bin_} - 1, t div {bin_} + 1)) AS bin")
    asked = topics.join(use, "meeting_id").selectExpr("meeting_id", "t", "title", f"t div {bin_} AS bin")
    met = asked.join(told, ["meeting_id", "bin"], "left").groupBy("meeting_id", "t", "title").agg(F.expr(f"coalesce(min_by(summary, idx) FILTER (WHERE abs(ct - t) <= {CHAPTER_NEAR_S}), '')").alias("summary"))
    return final.join(use, "meeting_id", "left_anti").select("meeting_id", "t", "title", "summary").unionByName(met.select("meeting_id", "t", "title", "summary"))


def condense_groups(partials: DataFrame, budget: int) -> DataFrame:
    """N15. The group (from 0) of each partial note (meeting_id, part, tokens) for one round of merging: consecutive parts up to
    80 % of the budget; meetings where nothing came together are taken in pairs. Meetings that fit the budget get no rows, so
    a caller merges, counts and asks again, CONDENSE_ROUNDS times at most."""
    kind = partials.schema["meeting_id"].dataType.simpleString()
    big = partials.groupBy("meeting_id").agg(F.sum("tokens").alias("all"), F.count("*").alias("n")).where(f"all > {budget} AND n > 1").select("meeting_id")

    def pack(rows: Iterator[tuple]) -> Iterator[tuple]:
        group, used = -1, None
        for meeting, part, tokens in rows:
            if used is None or used + tokens > 0.8 * budget:
                group, used = group + 1, 0
            used += tokens
            yield meeting, part, group

    packed = in_order(partials.join(big, "meeting_id").select("meeting_id", "part", "tokens"), ["meeting_id"], ["part"], pack, f"meeting_id {kind}, part long, g long")
    about = "OVER (PARTITION BY meeting_id)"
    rows = packed.selectExpr("*", f"max(g) {about} + 1 = count(*) {about} AS alone", "row_number() OVER (PARTITION BY meeting_id ORDER BY part) - 1 AS place")
    return rows.selectExpr("meeting_id", "part", "cast(if(alone, place div 2, g) AS bigint) AS group")
