"""Documents written of meetings: texts, subtitles, JSON (S). One row (meeting_id, text) is one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions.columns import subtitle_time

RULE = 72
NOTES = (
    "struct<summary:string,key_points:array<string>,decisions:array<string>,action_items:array<struct<task:string,owner:string,due:string,t:bigint,done:boolean>>,"
    "open_questions:array<string>,sections:array<struct<title:string,items:array<string>>>,chapters:array<struct<t:bigint,title:string,summary:string>>>"
)


def _sql_clock(t: str) -> str:
    return f"concat_ws(':', lpad({t} div 3600, 2, '0'), lpad({t} div 60 % 60, 2, '0'), lpad({t} % 60, 2, '0'))"


def _escape(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# How a heading ($t), an item (x), a line of text (x), a time ($x) and the end of a block are written.
STYLES = {
    "txt": {"head": "array(upper($t))", "item": "concat('  • ', x)", "text": "x", "done": ("[x] ", "[ ] "), "time": "concat('[', $x, '] ')", "dash": " - ", "end": "array('')", "say": "concat(time, name, ': ', text)"},
    "md": {"head": "array(concat('## ', $t), '')", "item": "concat('- ', x)", "text": "x", "done": ("- [x] ", "- [ ] "), "time": "concat('**', $x, '** ')", "dash": " — ", "end": "array('')", "say": "concat(time, '**', name, ':** ', text)"},
    "html": {"head": f"array(concat('<h2>', {_escape('$t')}, '</h2>'))", "item": f"concat('<li>', {_escape('x')}, '</li>')", "text": f"concat('<p>', {_escape('x')}, '</p>')", "done": ("<li>[x] ", "<li>[ ] "), "time": "concat('<b>', $x, '</b> ')", "dash": " — ", "end": "array('')", "say": f"concat('<p>', time, '<b>', {_escape('name')}, ':</b> ', {_escape('text')}, '</p>')"},
}


def _notes_lines(fmt: str, timestamps: bool) -> str:
    """The lines of the notes column, block after block; blocks without content are left out."""
    s = STYLES[fmt]

    def block(title: str, lines: str, there: str) -> str:
        return f"if({there}, concat({s['head'].replace('$t', title)}, {lines}, {s['end']}), array())"

    def items(column: str) -> str:
        return f"transform({column}, x -> {s['item']})"

    shut = "'</li>'" if fmt == "html" else "''"
    esc = _escape if fmt == "html" else lambda x: x
    about = "concat_ws('; ', nullif(a.owner, ''), if(coalesce(a.due, '') = '', NULL, concat('due ', a.due)))"
    at = f"if(a.t IS NULL, '', concat(' [', {_sql_clock('a.t')}, ']'))" if timestamps else "''"
    task = f"concat(a.task, if({about} = '', '', concat(' (', {about}, ')')), {at})"
    actions = f"transform(notes.action_items, a -> concat(if(coalesce(a.done, false), '{s['done'][0]}', '{s['done'][1]}'), {esc(task)}, {shut}))"
    mark = s["time"].replace("$x", _sql_clock("c.t")) if timestamps else "''"
    chapter = f"concat(c.title, if(coalesce(c.summary, '') = '', '', concat('{s['dash']}', c.summary)))"
    open_, lead = ("'<li>'", mark) if fmt == "html" else ("'- '" if fmt == "md" else "''", mark)
    chapters = f"transform(notes.chapters, c -> concat({open_}, {lead}, {esc(chapter)}, {shut}))"
    full = lambda c: f"coalesce(size({c}), 0) > 0"
    parts = [
        block("'Summary'", f"transform(array(notes.summary), x -> {s['text']})", "coalesce(notes.summary, '') <> ''"),
        *[block(f"'{title}'", items(f"notes.{name}"), full(f"notes.{name}")) for title, name in (("Key points", "key_points"), ("Decisions", "decisions"))],
        block("'Action items'", actions, full("notes.action_items")),
        block("'Open questions'", items("notes.open_questions"), full("notes.open_questions")),
        f"flatten(transform(coalesce(notes.sections, array()), b -> concat({s['head'].replace('$t', 'b.title')}, {items('b.items')}, {s['end']})))",
        block("'Chapters'", chapters, full("notes.chapters")),
    ]
    return f"concat({', '.join(parts)})"


def export_text(segments: DataFrame, names: DataFrame, meetings: DataFrame, fmt: str = "txt", notes: bool = True, transcript: bool = True, timestamps: bool = True) -> DataFrame:
    """S10. A `txt`, `md` or `html` document of each meeting: header, blocks of notes, transcript.

    segments: meeting_id, idx, speaker, start_ms, end_ms, text. names: meeting_id, key, name. meetings: id, title,
    date_s, duration_s, notes (NOTES, or null). Speakers are listed by their time. Null texts are empty; a
    meeting without segments has no transcript; a null title is `Meeting`.
    """
    who = segments.join(names.withColumnRenamed("key", "speaker"), ["meeting_id", "speaker"], "left").withColumn("name", F.coalesce("name", "speaker", F.lit("")))
    time = {"txt": "concat('[', {c}, '] ')", "md": "concat('`', {c}, '` ')", "html": "concat('<b>', {c}, '</b> ')"}[fmt].format(c=_sql_clock("(start_ms div 1000)"))
    said = who.selectExpr("meeting_id", "idx", "name", "coalesce(text, '') AS text", f"{time if timestamps else chr(39) * 2} AS time", "end_ms - start_ms AS ms")
    lines = said.withColumn("line", F.expr(STYLES[fmt]["say"])).groupBy("meeting_id").agg(F.expr("array_sort(collect_list(struct(idx, line)))").alias("l"))
    spoke = said.groupBy("meeting_id", "name").agg(F.sum("ms").alias("ms")).groupBy("meeting_id")
    spoke = spoke.agg(F.expr("array_join(transform(array_sort(collect_list(struct(-ms AS place, name))), s -> s.name), ', ')").alias("who"))
    rows = meetings.withColumnRenamed("id", "meeting_id").join(lines, "meeting_id", "left").join(spoke, "meeting_id", "left")
    meta = f"concat_ws(' · ', date_format(timestamp_seconds(date_s), 'EEEE dd MMMM yyyy, HH:mm'), concat('Duration ', {_sql_clock('duration_s')}), if(coalesce(who, '') = '', NULL, concat('Speakers: ', who)))"
    title = "coalesce(title, 'Meeting')"
    head = {
        "txt": f"array(upper({title}), {meta}, repeat('=', {RULE}), '')",
        "md": f"array(concat('# ', {title}), '', concat('*', {meta}, '*'), '')",
        "html": f"array(concat('<h1>', {_escape(title)}, '</h1>'), concat('<p>', {_escape(meta)}, '</p>'))",
    }[fmt]
    over = {"txt": f"array('TRANSCRIPT', repeat('-', {RULE}))", "md": "array('## Transcript', '')", "html": "array('<h2>Transcript</h2>')"}[fmt]
    parts = [head]
    if notes:
        parts.append(f"coalesce({_notes_lines(fmt, timestamps)}, array())")
    if transcript:
        parts.append(f"if(l IS NULL, array(), concat({over}, flatten(transform(l, x -> array(x.line, '')))))")
    return rows.selectExpr("meeting_id", f"concat(trim(BOTH '\\n' FROM array_join(concat({', '.join(parts)}), '\\n')), '\\n') AS text")


def export_subtitles(cues: DataFrame, fmt: str = "srt", speakers: bool = True) -> DataFrame:
    """S11. `srt` or `vtt` documents of cues (meeting_id, idx, cue, start_ms, end_ms, name, text); no cue is under 0.3 s."""
    mark = "," if fmt == "srt" else "."
    times = F.concat(subtitle_time("start_ms", mark), F.lit(" --> "), subtitle_time("greatest(end_ms, start_ms + 300)", mark))
    number = "row_number() OVER (PARTITION BY meeting_id ORDER BY idx, cue)"
    rows = cues.withColumns({"times": times, "number": F.expr(number)})
    said = {"srt": "concat(name, ': ', text)", "vtt": "concat('<v ', name, '>', text)"}[fmt] if speakers else "text"
    block = f"concat(times, '\\n', {said}, '\\n')"
    block = f"concat(number, '\\n', {block})" if fmt == "srt" else block
    out = rows.withColumn("block", F.expr(block)).groupBy("meeting_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(number, block))), x -> x.block), '\\n')").alias("text"))
    return out if fmt == "srt" else out.withColumn("text", F.concat(F.lit("WEBVTT\n\n"), F.col("text")))


def export_json(segments: DataFrame, names: DataFrame, meetings: DataFrame) -> DataFrame:
    """S12. A JSON document of each meeting (id, title, date_s, duration_s, and notes, NOTES, if it has them): title, date, speakers
    that spoke (by talk time), segments in order, and notes."""
    known = names.withColumnRenamed("key", "speaker")
    said = segments.join(known, ["meeting_id", "speaker"], "left").withColumn("name", F.coalesce("name", "speaker", F.lit("")))
    lines = said.groupBy("meeting_id").agg(F.expr("array_sort(collect_list(struct(idx, start_ms, end_ms, speaker, name, text)))").alias("segments"))
    spoke = said.groupBy("meeting_id", "speaker", "name").agg(F.sum(F.expr("end_ms - start_ms")).alias("talk_ms"))
    spoke = spoke.groupBy("meeting_id").agg(F.expr("transform(array_sort(collect_list(struct(-talk_ms AS place, speaker, name, talk_ms))), s -> struct(s.speaker AS key, s.name, s.talk_ms))").alias("speakers"))
    rows = meetings.withColumnRenamed("id", "meeting_id").join(lines, "meeting_id", "left").join(spoke, "meeting_id", "left")
    notes = ", notes" if "notes" in meetings.columns else ""
    return rows.select("meeting_id", F.to_json(F.expr(f"struct(meeting_id AS id, title, date_s, duration_s{notes}, coalesce(speakers, array()) AS speakers, coalesce(segments, array()) AS segments)")).alias("text"))

