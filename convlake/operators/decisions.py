"""What users decide after a meeting: who speaks, and corrections of segments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions.columns import strip
from convlake.functions.ordered import in_order
from convlake.functions.written import written

# The colours of speakers, in order.
PALETTE = "#8b5cf6 #06b6d4 #f59e0b #ec4899 #10b981 #3b82f6 #ef4444 #84cc16 #f97316 #14b8a6 #a855f7 #eab308 #0ea5e9 #f43f5e #22c55e #6366f1".split()
LEARN_MS, CLIP_MS = 2500, 12000

SPEAKER = "label string, color string, status string, speaker_id long, suggested_id long, talk_ms long"
NUMBER = "coalesce(try_cast(substr(key, 2) AS bigint), 99)"


def _told(decisions: DataFrame, meeting_speakers: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions with the person that a given id or name stands for, and people with those that names make: the first decision to
    learn a name that nobody has, on a key that its meeting has, makes a person; from then on the name is known in all meetings."""
    rows = decisions.selectExpr(
        "meeting_id", "seq", "key", "if(action IN ('reject', 'unlink', 'confirm', 'merge'), action, 'assign') AS action", f"nullif({strip('name')}, '') AS name",
        "speaker_id AS given", "coalesce(learn, true) AS learn", "target",
    ).withColumn("action", F.coalesce("action", F.lit("assign"))).withColumn("l", F.expr("if(action = 'assign' AND given IS NULL, lower(name), NULL)"))
    known = people.groupBy(F.lower("name").alias("l")).agg(F.min("id").alias("known"))
    rows = rows.join(known, "l", "left")
    makers = rows.where("l IS NOT NULL AND known IS NULL AND learn").join(meeting_speakers.select("meeting_id", "key"), ["meeting_id", "key"], "left_semi")
    born = makers.groupBy("l").agg(F.expr("min_by(struct(seq AS born_seq, meeting_id AS born_meeting, key AS born_key, name AS born_name), struct(seq, meeting_id, key))").alias("b")).select("l", "b.*")
    top = people.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top"))  # one row
    order = "ORDER BY born_seq, born_meeting, born_key"  # a row for each name that is new
    born = written(born.join(F.broadcast(top)).selectExpr("*", f"top + row_number() OVER ({order}) AS born"), "new-people")
    palette = ", ".join(f"'{c}'" for c in PALETTE)
    made = born.selectExpr("born AS id", "born_name AS name", f"element_at(array({palette}), cast((born - 1) % {len(PALETTE)} AS int) + 1) AS color")
    rows = rows.join(born, "l", "left")
    after = "struct(seq, meeting_id, key) >= struct(born_seq, born_meeting, born_key)"
    told = rows.selectExpr("meeting_id", "seq", "key", "action", "name", f"coalesce(given, known, if({after}, born, NULL)) AS who", "learn", "target")
    return told, people.select("id", "name", "color").unionByName(made)


class _Meeting:
    """The speakers of one meeting while its decisions are applied in order."""

    def __init__(self):
        self.rows: dict[str, dict] = {}
        self.people: dict[int, tuple] = {}
        self.moved: dict[str, str] = {}

    def name(self, key: str | None) -> str | None:
        row = self.rows.get(key)
        return key if row is None else (self.people.get(row["speaker_id"]) or (None,))[0] or row["label"] or key

    def merge(self, source: str, target: str) -> None:
        gone = self.rows.pop(source, None)
        if gone and target in self.rows:
            self.rows[target]["talk_ms"] = (self.rows[target]["talk_ms"] or 0) + (gone["talk_ms"] or 0)
        for key, at in self.moved.items():
            if at == source:
                self.moved[key] = target
        self.moved[source] = target
        self.moved.pop(target, None)

    def link(self, key: str, who: int) -> bool:
        """False where nobody has that id."""
        if who not in self.people:
            return False
        name, color = self.people[who]
        twice = next((k for k, r in self.rows.items() if k != key and r["speaker_id"] == who), None)
        self.rows[key] |= {"speaker_id": who, "status": "confirmed", "suggested_id": None, "label": name, "color": color}
        if twice is not None:
            self.merge(twice, key)
        return True

    def decide(self, action: str, key: str, who: int | None, name: str | None, target: str | None) -> tuple[bool, int | None]:
        """Whether the decision held, and the person linked by it."""
        if action == "merge":
            if not key or not target or key == target:
                return False, None
            self.merge(key, target)
            return True, None
        row = self.rows.get(key)
        if row is None:
            return False, None
        plain = f"Speaker {key[1:]}"
        if action == "reject":
            if row["status"] == "auto":
                row |= {"speaker_id": None, "label": plain}
            row |= {"status": "unknown", "suggested_id": None}
        elif action == "unlink":
            row |= {"status": "unknown", "speaker_id": None, "label": plain}
        elif action == "confirm" or who is not None:
            if action == "confirm":
                who = row["suggested_id"] if row["speaker_id"] is None else row["speaker_id"]
            return (True, who) if who is not None and self.link(key, who) else (False, None)
        elif name:
            row |= {"label": name, "speaker_id": None, "status": "named", "suggested_id": None}
        else:
            return False, None
        return True, None


COLUMNS = "what string, key string, seq long, label string, color string, status string, speaker_id long, suggested_id long, talk_ms long, old_name string, new_name string, learn boolean"


def _fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    meeting, now = None, _Meeting()
    for meeting, kind, seq, key, _, action, label, color, status, speaker_id, suggested_id, talk_ms, person, other, learn, target in rows:
        for i, known in ((speaker_id, person), (suggested_id, other)):
            if i is not None and known is not None:
                now.people[i] = (known["name"], known["color"])
        if kind == 0:
            now.rows[key] = {"label": label, "color": color, "status": status, "speaker_id": speaker_id, "suggested_id": suggested_id, "talk_ms": talk_ms}
            continue
        shown = target if action == "merge" else key
        old = now.name(key)
        held, linked = now.decide(action, key, speaker_id, label, target)
        if held:
            yield meeting, "decision", key, seq, None, None, action, linked, None, None, old, now.name(shown), bool(learn and linked is not None)
    for key, r in now.rows.items():
        yield meeting, "speaker", key, None, r["label"], r["color"], r["status"], r["speaker_id"], r["suggested_id"], r["talk_ms"], None, None, None
    for source, at in now.moved.items():
        yield meeting, "moved", source, None, at, None, None, None, None, None, None, None, None


def apply_decisions(meeting_speakers: DataFrame, decisions: DataFrame, people: DataFrame) -> dict[str, DataFrame]:
    """L21. Decisions (meeting_id, seq, key, action, speaker_id, name, learn, target) on the speakers of meetings (meeting_id, key, label, color,
    speaker_id, status, suggested_id, talk_ms), one after another in order of seq: each sees what those before it left.

    confirm links the match, else the suggestion; reject clears the suggestion, and of an automatic match also person and label; unlink
    clears person and label, not the suggestion; merge moves a key into `target`; any other action gives the person of that id or name. A
    name that nobody has makes a person, or without `learn` is a label of this meeting alone. A linked speaker gets label and
    colour of the person; another key of the meeting with that person is merged into the key just decided. Decisions on keys that are
    not there (any more), on unknown people, or with neither person nor name change nothing. Null `learn` is true.

    Gives `speakers`; `people` with those that were made (a name counts as made by its first learning decision, even if the key of that was
    merged away before); `moved` (meeting_id, source, target), for segments and turns; `names` (meeting_id, seq, old, new), for notes; and `learn`
    (meeting_id, seq, key, speaker_id), the voices to learn. The state of a fold is one meeting's speakers; rows are streamed."""
    told, known = _told(decisions, meeting_speakers, people)
    known = written(known, "people")
    person = known.select(F.col("id"), F.struct("name", "color").alias("person"))
    start = meeting_speakers.selectExpr("meeting_id", "0 AS kind", f"{NUMBER} AS seq", "key", "key AS place", "cast(NULL AS string) AS action", "label", "color", "status", "speaker_id", "suggested_id", "talk_ms")
    start = start.join(person.withColumnRenamed("id", "speaker_id"), "speaker_id", "left").join(person.selectExpr("id AS suggested_id", "person AS other"), "suggested_id", "left")
    acts = told.selectExpr("meeting_id", "1 AS kind", "seq", "key", "key AS place", "action", "name AS label", "who AS speaker_id", "learn", "target").join(person.withColumnRenamed("id", "speaker_id"), "speaker_id", "left")
    rows = start.unionByName(acts, allowMissingColumns=True)
    names = ["meeting_id", "kind", "seq", "key", "place", "action", "label", "color", "status", "speaker_id", "suggested_id", "talk_ms", "person", "other", "learn", "target"]
    kind = meeting_speakers.schema["meeting_id"].dataType.simpleString()
    done = written(in_order(rows.select(*names), ["meeting_id"], ["kind", "seq", "place"], _fold, f"meeting_id {kind}, {COLUMNS}"), "decided")
    held = done.where("what = 'decision'")
    return {
        "speakers": done.where("what = 'speaker'").select("meeting_id", "key", "label", "color", "speaker_id", "status", "suggested_id", "talk_ms"),
        "people": known,
        "moved": done.where("what = 'moved'").selectExpr("meeting_id", "key AS source", "label AS target"),
        "names": held.where("old_name <> new_name").selectExpr("meeting_id", "seq", "old_name AS old", "new_name AS new"),
        "learn": held.where("learn").select("meeting_id", "seq", "key", "speaker_id"),
    }


def confirm_all(meeting_speakers: DataFrame, meetings: DataFrame, people: DataFrame) -> dict[str, DataFrame]:
    """L21. What apply_decisions gives if all matches and suggestions of the meetings (meeting_id) are confirmed, in order of the keys. A
    key that an earlier one took in is gone by its turn."""
    rows = meeting_speakers.join(meetings.select("meeting_id").distinct(), "meeting_id", "left_semi")
    who = "CASE WHEN status IN ('auto', 'confirmed') THEN speaker_id WHEN status = 'suggested' THEN suggested_id END"
    acts = rows.selectExpr("meeting_id", f"{NUMBER} AS seq", "key", "'assign' AS action", f"{who} AS speaker_id", "cast(NULL AS string) AS name", "true AS learn", "cast(NULL AS string) AS target")
    return apply_decisions(meeting_speakers, acts.where("speaker_id IS NOT NULL"), people)


def apply_segment_edits(segments: DataFrame, edits: DataFrame, meeting_speakers: DataFrame) -> dict[str, DataFrame]:
    """L22. Edits (meeting_id, idx, seq, text, speaker, learn) of segments (meeting_id, idx, speaker, text, start_ms, end_ms, edited), in order of seq.

    A text that isn't blank counts, stripped; `edited` is set by any text or speaker given and never taken back. A speaker must be a
    key of meeting_speakers (meeting_id, key, label, color, speaker_id, talk_ms), or one that an earlier edit made: each `new` makes a key one
    above the largest number so far. Others are rejected, their text stays.

    Gives `segments`; `speakers` with the new keys and with talk times moved from key to key, floored at 0 after each step (a sum
    of steps, and the deepest of its partial sums, give what floors one after another give); and `clips` (meeting_id, idx, seq, speaker_id, start_ms,
    end_ms) to learn from: the first 12 s of segments of 2.5 s or more, if `learn` is asked for and the key has a person."""
    whole = segments.select("meeting_id", "idx", F.col("speaker").alias("first_speaker"), "start_ms", "end_ms")
    known = meeting_speakers.select("meeting_id", "key", "speaker_id")
    top = meeting_speakers.groupBy("meeting_id").agg(F.max(F.expr("try_cast(substr(key, 2) AS bigint)")).alias("top"))
    rows = edits.join(whole, ["meeting_id", "idx"]).join(top, "meeting_id", "left")
    rows = rows.selectExpr("*", f"nullif({strip('text')}, '') AS said", "nullif(speaker, '') AS asked")
    made = "count_if(asked = 'new') OVER (PARTITION BY meeting_id ORDER BY seq, idx ROWS UNBOUNDED PRECEDING)"
    rows = rows.selectExpr("*", f"coalesce(top, 0L) + {made} AS number").selectExpr("*", "if(asked = 'new', concat('S', number), asked) AS key")
    rows = rows.join(known, ["meeting_id", "key"], "left").join(known.selectExpr("meeting_id", "key", "true AS listed"), ["meeting_id", "key"], "left")
    own = "try_cast(substr(key, 2) AS bigint)"
    held = f"key IS NOT NULL AND (asked = 'new' OR coalesce(listed, false) OR coalesce(key = concat('S', {own}) AND {own} > coalesce(top, 0L) AND {own} <= number, false))"
    rows = written(rows.selectExpr("meeting_id", "idx", "seq", "said", "asked", f"if({held}, key, NULL) AS key", "number", "speaker_id", "learn", "first_speaker", "start_ms", "end_ms"), "segment-edits")

    last = rows.groupBy("meeting_id", "idx").agg(F.expr("max_by(said, seq) FILTER (WHERE said IS NOT NULL)").alias("said"), F.expr("max_by(key, seq) FILTER (WHERE key IS NOT NULL)").alias("told"))
    done = segments.join(last, ["meeting_id", "idx"], "left")
    done = done.selectExpr("meeting_id", "idx", "coalesce(told, speaker) AS speaker", "coalesce(said, text) AS text", "start_ms", "end_ms", "coalesce(edited, false) OR said IS NOT NULL OR told IS NOT NULL AS edited")

    moved = rows.where("key IS NOT NULL").selectExpr("*", "lag(key, 1, first_speaker) OVER (PARTITION BY meeting_id, idx ORDER BY seq) AS before")
    steps = moved.selectExpr("meeting_id", "seq", "idx", "posexplode(array(struct(before AS key, start_ms - end_ms AS d), struct(key AS key, end_ms - start_ms AS d))) AS (step, m)")
    sums = steps.selectExpr("meeting_id", "m.key AS key", "sum(m.d) OVER (PARTITION BY meeting_id, m.key ORDER BY seq, idx, step ROWS UNBOUNDED PRECEDING) AS s", "m.d AS d")
    total = sums.groupBy("meeting_id", "key").agg(F.sum("d").alias("total"), F.min("s").alias("deepest"))
    fresh = rows.where("asked = 'new'").selectExpr("meeting_id", "key", "concat('Speaker ', number) AS label", "number", "row_number() OVER (PARTITION BY meeting_id ORDER BY number) AS place")
    used = meeting_speakers.groupBy("meeting_id").agg(F.collect_set("color").alias("used"))
    palette = "array(" + ", ".join(f"'{c}'" for c in PALETTE) + ")"
    free = f"coalesce(get(array_except({palette}, coalesce(used, array())), place - 1), get({palette}, cast(number % {len(PALETTE)} AS int)))"
    fresh = fresh.join(used, "meeting_id", "left").selectExpr("meeting_id", "key", "label", f"{free} AS color", "cast(NULL AS bigint) AS speaker_id", "'unknown' AS status", "0L AS talk_ms")
    speakers = meeting_speakers.select("meeting_id", "key", "label", "color", "speaker_id", "status", "talk_ms").unionByName(fresh).join(total, ["meeting_id", "key"], "left")
    talk = "if(total IS NULL, talk_ms, total + greatest(coalesce(talk_ms, 0L), -deepest))"
    clips = rows.where(f"key IS NOT NULL AND learn AND speaker_id IS NOT NULL AND end_ms - start_ms >= {LEARN_MS}")
    return {
        "segments": done,
        "speakers": speakers.selectExpr("meeting_id", "key", "label", "color", "speaker_id", "status", f"{talk} AS talk_ms"),
        "clips": clips.selectExpr("meeting_id", "idx", "seq", "speaker_id", "start_ms", f"least(end_ms, start_ms + {CLIP_MS}) AS end_ms"),
    }
