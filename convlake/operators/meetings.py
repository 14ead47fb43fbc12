"""Lists of meetings, edits, decisions and deletions (P, L, M, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions.columns import note_key, strip

VOCABULARY_NAMES, VOCABULARY_CHARS = 30, 600
TITLE_CHARS, TAG_CHARS, MOST_TAGS = 200, 40, 20


def list_meetings(meetings: DataFrame, meeting_speakers: DataFrame, q: str = "", favorites: bool = False) -> DataFrame:
    """P2. Meetings (id, title, summary, created_s, recorded_s, favorite) that hold q in title or summary, a-z and A-Z alike,
    the newest first, with the keys of their speakers by talk time."""
    ascii_lower = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    wanted = F.translate(F.lit(q.strip()), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = meetings.where(F.contains(F.expr(ascii_lower.format(c="title")), wanted) | F.contains(F.expr(ascii_lower.format(c="summary")), wanted))
    rows = rows.where("favorite") if favorites else rows
    cards = meeting_speakers.groupBy(F.col("meeting_id").alias("id")).agg(F.expr("transform(array_sort(collect_list(struct(-talk_ms AS t, key))), s -> s.key)").alias("speakers"))
    rows = rows.selectExpr("id", "title", "coalesce(recorded_s, created_s) AS date_s").join(cards, "id", "left")
    return rows.selectExpr("id", "title", "date_s", "array_join(coalesce(speakers, array()), ',') AS speakers").orderBy(F.desc("date_s"), "id")


def speaker_meetings(meetings: DataFrame, meeting_speakers: DataFrame, speaker_id: int) -> DataFrame:
    """P3. The meetings of one person, the newest first, with its talk time."""
    own = meeting_speakers.where(F.col("speaker_id") == speaker_id).groupBy(F.col("meeting_id").alias("id")).agg(F.sum("talk_ms").alias("talk_ms"))
    return meetings.join(own, "id").selectExpr("id", "title", "coalesce(recorded_s, created_s) AS date_s", "talk_ms").orderBy(F.desc("date_s"), "id")


def find_by_name(people: DataFrame, names: DataFrame) -> DataFrame:
    """P4. For each asked name the person (the smallest id) of that name, case and outer spaces aside; unknown names are left out."""
    known = people.groupBy(F.expr("lower(trim(name))").alias("l")).agg(F.min("id").alias("id"))
    return names.select("name", F.lower(F.expr(strip("name"))).alias("l")).distinct().join(known, "l").select("name", "id")


def vocabulary(options: DataFrame, people: DataFrame) -> DataFrame:
    """P6. Per meeting (meeting_id, vocabulary) the words given, split at commas, semicolons and lines, then the names changed
    last (id, name, updated), 30 of them; of words that differ in case the first, 600 characters in all."""
    recent = people.where("name IS NOT NULL").orderBy(F.desc("updated"), "id").limit(VOCABULARY_NAMES)
    names = recent.groupBy().agg(F.expr("transform(array_sort(collect_list(struct(-updated AS u, id, name))), n -> n.name)").alias("names"))  # one row
    rows = options.join(F.broadcast(names)).select("meeting_id", F.posexplode(F.expr(f"concat(filter(transform(split(coalesce(vocabulary, ''), '[,\\n;]+'), w -> {strip('w')}), w -> w <> ''), names)")).alias("pos", "word"))
    first = rows.groupBy("meeting_id", F.lower("word").alias("l")).agg(F.expr("min_by(struct(pos, word), pos)").alias("w"))
    out = first.groupBy("meeting_id").agg(F.expr("left(array_join(transform(array_sort(collect_list(w)), x -> x.word), ', '), %d)" % VOCABULARY_CHARS).alias("words"))
    return options.select("meeting_id").join(out, "meeting_id", "left").selectExpr("meeting_id", "coalesce(words, '') AS words")


def apply_meeting_edits(meetings: DataFrame, edits: DataFrame) -> DataFrame:
    """P10. Meetings (id, title, favorite, tags, locked) after edits (id, seq, title, favorite, tags) in order; null fields leave things as they
    are. A title is stripped and cut to 200 characters, and locks; a blank one counts as none. Of tags the first 20 are kept, of each
    40 characters, as they stand."""
    named = edits.withColumn("named", F.expr(f"left(nullif({strip('title')}, ''), {TITLE_CHARS})"))
    last = named.groupBy("id").agg(*[F.expr(f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL)").alias(a) for c, a in (("named", "named"), ("favorite", "f"), ("tags", "g"))])
    rows = meetings.join(last, "id", "left")
    tags = f"transform(slice(g, 1, {MOST_TAGS}), x -> left(x, {TAG_CHARS}))"
    return rows.selectExpr("id", "coalesce(named, title) AS title", "coalesce(f, favorite) AS favorite", f"coalesce({tags}, tags) AS tags", "locked OR named IS NOT NULL AS locked")


def expected_time(models: DataFrame, measured: DataFrame, threads: int, gpu: bool = False) -> DataFrame:
    """M6. Minutes for an hour of audio: the measured rate (key, value) of a model (key, cpu, gpu), else its prior, on CPUs times
    max(0.5, 4 / threads)."""
    prior = "gpu" if gpu else f"cpu * {max(0.5, 4 / threads)!r}D"
    rows = models.join(measured.select("key", "value"), "key", "left")
    return rows.selectExpr("key", "value IS NOT NULL AS measured", f"60D * coalesce(value, {prior}) AS minutes")


def drop_samples(samples: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L16. The samples (id, clip, ..) without those gone (id), and the clips that no sample uses any more."""
    left = samples.join(gone.select("id"), "id", "left_anti")
    clips = samples.join(gone.select("id"), "id", "left_semi").where("clip IS NOT NULL").select("clip").distinct()
    return left, clips.join(left.select("clip"), "clip", "left_anti")


def delete_speakers(meeting_speakers: DataFrame, people: DataFrame, gone: DataFrame) -> DataFrame:
    """L17. meeting_speakers once people (id) are deleted: their meetings keep the name as label and become unknown, suggestions
    of them are cleared."""
    named = gone.select("id").distinct().join(people.select("id", "name"), "id", "left")
    rows = meeting_speakers.join(named.selectExpr("id AS speaker_id", "name AS was", "true AS lost"), "speaker_id", "left")
    rows = rows.join(gone.selectExpr("id AS suggested_id", "true AS unsaid").distinct(), "suggested_id", "left")
    return rows.selectExpr(
        "meeting_id", "key", "if(lost, coalesce(was, label), label) AS label", "if(lost, 'unknown', status) AS status",
        "if(lost, NULL, speaker_id) AS speaker_id", "if(unsaid, NULL, suggested_id) AS suggested_id",
    )


def delete_meetings(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """L17. Tables with a meeting_id without the rows of the deleted meetings (meeting_id)."""
    return {name: rows.join(gone.select("meeting_id"), "meeting_id", "left_anti") for name, rows in tables.items()}


def action_items(meetings: DataFrame) -> DataFrame:
    """N17. The tasks of all meetings (id, title, date_s, action_items) with their number, the newest meeting first. A null list has none."""
    rows = meetings.select(F.col("id").alias("meeting_id"), "title", "date_s", F.posexplode("action_items").alias("number", "a"))
    return rows.selectExpr("meeting_id", "title", "date_s", "cast(number AS bigint) AS number", "a.*").orderBy(F.desc("date_s"), "meeting_id", "number")


def update_actions(items: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N19. Items (meeting_id, number, task, owner, due, done) after the last change (meeting_id, number, seq, and any of the four)
    of each, null fields as they were; and the changes of items that aren't there."""
    last = changes.groupBy("meeting_id", "number").agg(F.expr("max_by(struct(task, owner, due, done), seq)").alias("c"))
    done = items.join(last, ["meeting_id", "number"], "left").selectExpr("meeting_id", "number", *[f"coalesce(c.{x}, {x}) AS {x}" for x in ("task", "owner", "due", "done")])
    return done, changes.join(items.select("meeting_id", "number"), ["meeting_id", "number"], "left_anti")


def owners(items: DataFrame) -> DataFrame:
    """N18. The distinct owners of tasks, case and marks aside, each as first in order."""
    return items.where("owner <> ''").groupBy(note_key("owner").alias("k")).agg(F.min("owner").alias("owner")).select("owner")
