"""All queries of the library's own operators by name, with their DuckDB twins.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import payload, picks, render
from parlance.functions import text as t
from parlance.functions import vectors as v
from parlance.operators import catalog, cluster, dml, evaluate, ordered, search, sessions, similar
from parlance.plans import projections as p
from parlance.sources import files
from parlance.streaming import chunks, recorder, replies

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *relations: str):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = p.with_sql(sql, *relations) if relations else sql
        return f

    return add


# --- search -----------------------------------------------------------------------------------

TERMS = "that with"
_BM25 = """
WITH toks AS (
  SELECT *, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS tokens FROM segments),
tf AS (SELECT *, len(tokens) AS dl, len(list_filter(tokens, lambda x: x = 'that')) AS a, len(list_filter(tokens, lambda x: x = 'with')) AS b FROM toks),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count_if(a > 0) AS na, count_if(b > 0) AS nb FROM tf),
idf AS (SELECT *, CASE WHEN ln((n - na + 0.5) / (na + 0.5)) > 0 THEN ln((n - na + 0.5) / (na + 0.5)) ELSE 1e-6 END AS ia,
               CASE WHEN ln((n - nb + 0.5) / (nb + 0.5)) > 0 THEN ln((n - nb + 0.5) / (nb + 0.5)) ELSE 1e-6 END AS ib FROM st),
ranked AS (
  SELECT meeting_id, seg_id, start_ms, round(- ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) - ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) AS rank
  FROM tf, idf WHERE a > 0 AND b > 0)
"""


@query("b05_bm25_rank", _BM25 + "SELECT meeting_id, seg_id, start_ms, rank FROM ranked", "segments")
def _(spark, sf):
    return search.scored(p.segments(spark, sf), TERMS).select("meeting_id", "seg_id", "start_ms", "rank")


@query(
    "b05_bm25_search",
    _BM25.rstrip() + """,
top AS (SELECT * FROM ranked ORDER BY rank, seg_id LIMIT 80),
one AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY rank, seg_id) AS rn FROM top)
SELECT meeting_id, seg_id, start_ms, rank FROM one WHERE rn = 1 ORDER BY rank, seg_id LIMIT 20""",
    "segments",
)
def _(spark, sf):
    return search.search(p.segments(spark, sf), TERMS, 20).select("meeting_id", "seg_id", "start_ms", "rank")


@query(
    "b03_phrase_match",
    """SELECT seg_id FROM segments WHERE regexp_matches(' ' || array_to_string(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ', ' of the ')""",
    "segments",
)
def _(spark, sf):
    return search.scored(p.segments(spark, sf), "of.the").select("seg_id")


@query(
    "b02_folded_tokens",
    """SELECT doc_id, len(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS tokens,
       len(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x = 'que')) AS que FROM documents""",
)
def _(spark, sf):
    toks = search.tokens(F.col("text"))
    return p.table(spark, sf, "documents").select("doc_id", F.size(toks).cast("long").alias("tokens"), search.phrase_count(toks, ["que"]).cast("long").alias("que"))


@query("b08_snippets")
def _(spark, sf):
    hits = search.search(p.segments(spark, sf), TERMS, 20)
    return search.with_snippets(hits, TERMS).select("meeting_id", "seg_id", "snippet", search.plain_snippet(F.col("snippet")).alias("plain"))


# --- catalogue --------------------------------------------------------------------------------


@query("o00_top_meetings", "SELECT meeting_id, title, started_ms, ended_ms, duration_ms, segment_count FROM meetings WHERE ended_ms IS NOT NULL ORDER BY started_ms DESC, meeting_id LIMIT 20", "meetings")
def _(spark, sf):
    return catalog.newest_meetings(p.meetings(spark, sf), 20)


@query("p02_finished_meetings", "SELECT meeting_id, title, started_ms, ended_ms, duration_ms, segment_count FROM meetings WHERE ended_ms IS NOT NULL", "meetings")
def _(spark, sf):
    return catalog.newest_meetings(p.meetings(spark, sf))


@query("s03_meeting_header", "SELECT meeting_id, title, started_ms, ended_ms, duration_ms, segment_count FROM meetings WHERE meeting_id = 7", "meetings")
def _(spark, sf):
    return catalog.header(p.meetings(spark, sf), 7)


@query("s04_segments_of_meeting", "SELECT seg_id, start_ms, end_ms, text FROM segments WHERE meeting_id = 7", "segments")
def _(spark, sf):
    return p.segments(spark, sf).filter("meeting_id = 7").select("seg_id", "start_ms", "end_ms", "text").orderBy("start_ms", "seg_id")


@query("a02_finished_count", "SELECT count(*) AS meetings FROM meetings WHERE ended_ms IS NOT NULL", "meetings")
def _(spark, sf):
    return catalog.total_finished(p.meetings(spark, sf))


@query(
    "j03_labelled_segments",
    """SELECT s.seg_id, CASE WHEN trim(p.label) <> '' THEN p.label ELSE 'Speaker ' || (p.slot + 1) END AS speaker
FROM segments s LEFT JOIN speakers p ON s.meeting_id = p.meeting_id AND s.role = p.role""",
    "segments", "speakers",
)
def _(spark, sf):
    return catalog.labelled_segments(p.segments(spark, sf), p.speakers(spark, sf)).select("seg_id", "speaker")


@query(
    "j04_nested_meetings",
    """SELECT m.meeting_id, m.title, (SELECT count(*) FROM segments s WHERE s.meeting_id = m.meeting_id) AS n_segments,
  coalesce((SELECT string_agg(seg_id || ':' || role, ',' ORDER BY start_ms, seg_id) FROM segments s WHERE s.meeting_id = m.meeting_id), '') AS segment_list,
  coalesce((SELECT string_agg(slot || ':' || role, ',' ORDER BY slot) FROM speakers s WHERE s.meeting_id = m.meeting_id), '') AS speaker_list,
  coalesce((SELECT string_agg(note_id::VARCHAR, ',' ORDER BY timestamp_ms, note_id) FROM notes s WHERE s.meeting_id = m.meeting_id), '') AS note_list
FROM meetings m""",
    "meetings", "speakers", "notes",
)
def _(spark, sf):
    df = catalog.nested(p.meetings(spark, sf), p.segments(spark, sf), p.speakers(spark, sf), p.notes(spark, sf))
    pairs = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x[b])), ",")
    ids = F.array_join(F.transform("notes", lambda x: x["note_id"].cast("string")), ",")
    return df.select("meeting_id", "title", F.size("segments").cast("long").alias("n_segments"), pairs("segments", "seg_id", "role").alias("segment_list"), pairs("speakers", "slot", "role").alias("speaker_list"), ids.alias("note_list"))


@query("j05_segment_counts", "SELECT m.meeting_id, (SELECT count(DISTINCT seg_id) FROM segments s WHERE s.meeting_id = m.meeting_id) AS segments FROM meetings m", "meetings")
def _(spark, sf):
    return catalog.segment_counts(p.meetings(spark, sf), p.segments(spark, sf))


@query("a03_dominant_language", """SELECT source, lang, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY votes DESC, lang) AS rn FROM (SELECT source, lang, count(*) AS votes FROM documents WHERE lang IS NOT NULL GROUP BY source, lang)) WHERE rn = 1""")
def _(spark, sf):
    return catalog.dominant(p.table(spark, sf, "documents"), ["source"], "lang").select("source", "lang", "votes")


@query("a15_participants", "SELECT meeting_id, string_agg(coalesce(label, 'Speaker ' || (slot + 1)), ', ' ORDER BY slot) AS participants FROM speakers GROUP BY meeting_id", "speakers")
def _(spark, sf):
    return catalog.participants(p.speakers(spark, sf))


@query("a16_full_text", r"""SELECT meeting_id, string_agg(x, ' ' ORDER BY turn) AS full_text FROM (
  SELECT meeting_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM segments) WHERE x <> '' GROUP BY meeting_id""", "segments")
def _(spark, sf):
    return catalog.joined_text(p.segments(spark, sf), "meeting_id", ["turn"], t.trimmed(F.col("text")), " ", "full_text")


@query("o01_timeline", """SELECT meeting_id, start_ms AS at_ms, 'segment' AS kind, seg_id AS id FROM segments UNION ALL SELECT meeting_id, timestamp_ms, 'note', note_id FROM notes""", "segments", "notes")
def _(spark, sf):
    return catalog.timeline(p.segments(spark, sf), p.notes(spark, sf))


@query("o02_latest_summary", """SELECT meeting_id, summary_id, template FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY created_at DESC, summary_id DESC) AS rn FROM summaries) WHERE rn = 1""", "summaries")
def _(spark, sf):
    return catalog.latest_summary(p.summaries(spark, sf)).select("meeting_id", "summary_id", "template")


@query("t15_payload_fields", "SELECT summary_id, template, md5(summary) AS summary FROM summaries", "summaries")
def _(spark, sf):
    field = lambda x: F.get_json_object("payload", f"$.{x}").alias(x)
    return p.summaries(spark, sf).select("summary_id", field("template"), F.md5(F.get_json_object("payload", "$.summary")).alias("summary"))


@query("p10_chat_history", """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 20 AND role <> 'system'""")
def _(spark, sf):
    return ordered.last_rows(p.table(spark, sf, "conversations"), ["conv_id"], ["turn"], 20).filter("role <> 'system'").select("conv_id", "turn", "role")


@query("j06_valid_citations", """WITH cited AS (SELECT conv_id AS meeting_id, turn, conv_id * 100000 + (turn * 7) % 9 AS seg_id FROM conversations)
SELECT c.meeting_id, c.turn, c.seg_id FROM cited c SEMI JOIN segments s ON c.seg_id = s.seg_id AND c.meeting_id = s.meeting_id""", "segments")
def _(spark, sf):
    cited = p.table(spark, sf, "conversations").select(F.col("conv_id").alias("meeting_id"), "turn", (F.col("conv_id") * 100000 + F.col("turn") * 7 % 9).alias("seg_id"))
    return cited.join(p.segments(spark, sf).select("meeting_id", "seg_id"), ["meeting_id", "seg_id"], "left_semi").select("meeting_id", "turn", "seg_id")


@query("j08_paired_by_stem", """SELECT b.item_id, d.doc_id FROM (SELECT item_id, 'clip' || item_id AS stem FROM benchmark) b JOIN (SELECT doc_id, 'clip' || doc_id AS stem FROM documents) d USING (stem)""")
def _(spark, sf):
    stem = lambda c: files.stem(F.concat(F.lit("/audio/clip"), F.col(c), F.lit(".wav")))
    b = p.table(spark, sf, "benchmark").select("item_id", stem("item_id").alias("stem"))
    return b.join(p.table(spark, sf, "documents").select("doc_id", stem("doc_id").alias("stem")), "stem").select("item_id", "doc_id")


# --- windows ----------------------------------------------------------------------------------


@query("w01_slot_backfill", "SELECT meeting_id, role, row_number() OVER (PARTITION BY meeting_id ORDER BY role) - 1 AS slot FROM speakers", "speakers")
def _(spark, sf):
    return ordered.numbered(p.speakers(spark, sf).drop("slot"), ["meeting_id"], ["role"], "slot").select("meeting_id", "role", "slot")


@query("w03_arrival_slots", """WITH f AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL)
SELECT a.conv_id AS meeting_id, a.role, count(b.role)::INTEGER AS slot, CASE WHEN a.role <> 'assistant' THEN upper(a.role[1]) || a.role[2:] END AS label
FROM f a LEFT JOIN f b ON a.conv_id = b.conv_id AND (b.first_turn, b.role) < (a.first_turn, a.role) GROUP BY a.conv_id, a.role""")
def _(spark, sf):
    return p.speakers(spark, sf)


@query("w04_chunk_offsets", "SELECT session_id, seq, coalesce(sum(duration_ms) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ms FROM session_events", "session_events")
def _(spark, sf):
    return ordered.offset_before(p.session_events(spark, sf), ["session_id"], ["seq"], F.col("duration_ms"), "offset_ms").select("session_id", "seq", "offset_ms")


@query("w05_chunk_index", "SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS chunk_index FROM session_events WHERE type IN ('chunk', 'skipped')", "session_events")
def _(spark, sf):
    return ordered.numbered(p.session_events(spark, sf).filter("type IN ('chunk', 'skipped')"), ["session_id"], ["seq"], "chunk_index").select("session_id", "seq", "chunk_index")


@query("w06_pause_edges", """SELECT session_id, seq, type FROM (
  SELECT *, lag(type, 1, 'resumed') OVER (PARTITION BY session_id ORDER BY seq) AS prior FROM session_events WHERE type IN ('paused', 'resumed')) WHERE type <> prior""", "session_events")
def _(spark, sf):
    return sessions.pause_edges(p.session_events(spark, sf)).select("session_id", "seq", "type")


@query("w08_activity_runs", """SELECT session_id, min(seq) AS "start", max(seq) + 1 AS "end", count(*) AS length FROM (
  SELECT session_id, seq, seq - row_number() OVER (PARTITION BY session_id ORDER BY seq) AS island FROM session_events WHERE rms >= 0.01)
GROUP BY session_id, island HAVING count(*) >= 2""", "session_events")
def _(spark, sf):
    return ordered.runs(p.session_events(spark, sf), ["session_id"], "seq", F.col("rms") >= 0.01, 2)


@query("w09_last_lines", "SELECT session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM session_events) WHERE rn <= 500", "session_events")
def _(spark, sf):
    return ordered.last_rows(p.session_events(spark, sf), ["session_id"], ["seq"], 500).select("session_id", "seq")


# --- changes ----------------------------------------------------------------------------------


@query("d02_append_segments", """WITH base AS (SELECT seg_id, text FROM segments WHERE turn < 3), batch AS (SELECT seg_id, text FROM segments UNION ALL SELECT seg_id, text FROM segments)
SELECT seg_id, text FROM base UNION ALL SELECT seg_id, min(text) FROM batch ANTI JOIN base USING (seg_id) GROUP BY seg_id""", "segments")
def _(spark, sf):
    s = p.segments(spark, sf).select("seg_id", "turn", "text")
    # The batch holds what is there already, and all of its rows twice.
    return dml.append_new(s.filter("turn < 3"), s.unionByName(s), "seg_id", ["turn"]).select("seg_id", "text")


@query("d03_upsert_speakers", """SELECT meeting_id, slot, role AS id, coalesce(CASE WHEN meeting_id % 3 = 0 THEN 'Guest ' || slot END, label) AS label FROM speakers""", "speakers")
def _(spark, sf):
    s = p.speakers(spark, sf).select("meeting_id", "slot", F.col("role").alias("id"), "label")
    first = s.select("meeting_id", "slot", F.lit("other").alias("id"), F.when(F.col("meeting_id") % 3 == 0, F.concat(F.lit("Guest "), F.col("slot"))).alias("label"), F.lit(1).cast("long").alias("seq"))
    second = first.withColumn("label", F.lit(None).cast("string")).withColumn("seq", F.lit(2).cast("long"))
    return dml.upsert_speakers(s, first.unionByName(second))


@query("d04_upsert_summaries", """SELECT meeting_id, template, max(summary_id) AS summary_id FROM summaries GROUP BY ALL""", "summaries")
def _(spark, sf):
    s = p.summaries(spark, sf).select("meeting_id", "template", "summary_id")
    first = ordered.best_per_key(s, ["meeting_id", "template"], [F.col("summary_id")])
    return dml.upsert_last(first, s.withColumn("seq", F.col("summary_id")), ["meeting_id", "template"]).select("meeting_id", "template", "summary_id")


@query("d05_finalise", """SELECT meeting_id, coalesce(ended_ms, started_ms + 5000) AS ended_ms, CASE WHEN ended_ms IS NULL THEN 'done' ELSE title END AS title FROM meetings""", "meetings")
def _(spark, sf):
    m = p.meetings(spark, sf).select("meeting_id", "started_ms", "ended_ms", "title")
    patch = m.filter("ended_ms IS NULL").select("meeting_id", (F.col("started_ms") + 5000).alias("ended_ms"), F.lit("done").alias("title"))
    return dml.patched(m, patch, "meeting_id").select("meeting_id", "ended_ms", "title")


@query("d06_rename_speaker", "SELECT meeting_id, role, CASE WHEN meeting_id = 5 AND role = 'user' THEN 'Ana' ELSE label END AS label FROM speakers", "speakers")
def _(spark, sf):
    return dml.set_where(p.speakers(spark, sf), (F.col("meeting_id") == 5) & (F.col("role") == "user"), "label", F.lit("Ana")).select("meeting_id", "role", "label")


@query("d07_delete_cascade", "SELECT 'segments' AS relation, count(*) AS n FROM segments WHERE meeting_id % 4 <> 0 UNION ALL SELECT 'speakers', count(*) FROM speakers WHERE meeting_id % 4 <> 0 UNION ALL SELECT 'notes', count(*) FROM notes WHERE meeting_id % 4 <> 0", "segments", "speakers", "notes")
def _(spark, sf):
    tables = {"segments": p.segments(spark, sf), "speakers": p.speakers(spark, sf), "notes": p.notes(spark, sf)}
    gone = p.meetings(spark, sf).select("meeting_id").unionByName(p.notes(spark, sf).select("meeting_id")).filter("meeting_id % 4 = 0").distinct()
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in dml.delete_cascade(tables, gone).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- aggregates -------------------------------------------------------------------------------


@query("a04_recorder_totals", """WITH e AS (
  SELECT *, (seq + 1) * 100 AS at_ms, CASE WHEN type = 'skipped' THEN duration_ms ELSE 0 END AS skip FROM session_events),
f AS (SELECT *, coalesce(sum(skip) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM e)
SELECT session_id, count_if(type = 'chunk') AS chunks, count_if(type = 'skipped') AS skipped,
  greatest(coalesce(max(CASE WHEN type = 'chunk' THEN at_ms + later END), 0), sum(skip))::BIGINT AS duration_ms FROM f GROUP BY session_id""", "session_events")
def _(spark, sf):
    return sessions.recorder_totals(p.session_events(spark, sf).withColumn("at_ms", (F.col("seq") + 1) * 100))


@query("a07_rms", "SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY user_id")
def _(spark, sf):
    return p.table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))


@query("a08_voice_statistics", """SELECT session_id, max(rms) AS peak, round(avg(rms), 9) AS mean, count(*) AS n, count_if(rms >= 0.02) AS over_start, count_if(rms >= 0.01) AS over_end, bool_or(rms >= 0.02) AS voiced FROM session_events GROUP BY session_id""", "session_events")
def _(spark, sf):
    r = F.col("rms")
    return p.session_events(spark, sf).groupBy("session_id").agg(
        F.max(r).alias("peak"), F.round(F.avg(r), 9).alias("mean"), F.count("*").alias("n"), F.count_if(r >= 0.02).alias("over_start"), F.count_if(r >= 0.01).alias("over_end"), F.bool_or(r >= 0.02).alias("voiced")
    )


@query("a10_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN i = floor((n - 1) * 0.5 + 0.5) THEN value END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.95 + 0.5) THEN value END) AS p95 FROM r GROUP BY event_type""")
def _(spark, sf):
    return evaluate.nearest_rank(p.table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("a14_dominant_speaker", """SELECT meeting_id, role AS speaker FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY end_ms - start_ms DESC, start_ms, role DESC) AS rn FROM segments) WHERE rn = 1""", "segments")
def _(spark, sf):
    return sessions.dominant_speaker(p.segments(spark, sf).withColumn("speaker", F.col("role")), ["meeting_id"])


@query("p07_silence_gate", "SELECT session_id, seq, rms < 0.02 AS skipped FROM session_events", "session_events")
def _(spark, sf):
    return p.session_events(spark, sf).select("session_id", "seq", sessions.silence_gate(F.col("rms"), 0.02).alias("skipped"))


# --- text -------------------------------------------------------------------------------------


@query("t01_speaker_names", "SELECT meeting_id, slot, CASE WHEN trim(label) <> '' THEN label ELSE 'Speaker ' || (slot + 1) END AS name, 'S' || (slot + 1) AS tag, slot % 8 AS colour FROM speakers", "speakers")
def _(spark, sf):
    return p.speakers(spark, sf).select("meeting_id", "slot", t.speaker_name(F.col("label"), F.col("slot")).alias("name"), t.short_tag(F.col("slot")).alias("tag"), t.palette(F.col("slot")).alias("colour"))


_NESTED = "<|im_end|>a<|eot_id|>b<|start_header_id|>c<|end_header_id|><|im_st</s>art|>"


def _removed(x: str, tokens) -> str:
    for token in tokens:
        x = f"replace({x}, '{token}', '')"
    return x


@query("t05_control_tokens", f"SELECT conv_id, turn, {_removed(f"'<|im_start|>' || text || '{_NESTED}'", t.CONTROL_TOKENS)} AS plain FROM conversations")
def _(spark, sf):
    # Removing the last token makes the first one anew, which stays: each is removed once.
    return p.table(spark, sf, "conversations").select("conv_id", "turn", t.without_control_tokens(F.concat(F.lit("<|im_start|>"), "text", F.lit(_NESTED))).alias("plain"))


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


@query("t06_punctuated", rf"""WITH a AS (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents),
b AS (SELECT *, regexp_split_to_array(lower(x), '\s+') AS w FROM a),
c AS (SELECT *, x LIKE '¿%' OR CASE WHEN lang LIKE 'es%' THEN w[1] IN {_in(t.SPANISH_QUESTIONS)} OR (w[1] IN {_in(t.SPANISH_PREPOSITIONS)} AND w[2] IN {_in(t.SPANISH_AFTER)})
  ELSE w[1] IN {_in((*t.INTERROGATIVES, *t.AUXILIARIES))} END AS q FROM b)
SELECT doc_id, md5(CASE WHEN x = '' THEN '' ELSE upper(x[1]) || x[2:] || CASE WHEN x[-1] IN ('.', '!', '?', '…', ':', ';') THEN '' WHEN q THEN '?' ELSE '.' END END) AS sentence FROM c""")
def _(spark, sf):
    return p.table(spark, sf, "documents").select("doc_id", F.md5(t.punctuated(F.col("text"), F.col("lang"))).alias("sentence"))


@query("t08_hallucinations", rf"""WITH a AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '[' || text || ']' WHEN 1 THEN '¡Gracias por ver el vídeo!' WHEN 2 THEN ' BLANK_AUDIO. ' ELSE text END AS x FROM conversations),
b AS (SELECT *, trim(x) AS y FROM a)
SELECT conv_id, turn, (y LIKE '[%' AND y LIKE '%]') OR regexp_replace(replace(translate(lower(regexp_replace(y, '^[[:punct:]¡¿…]+|[[:punct:]¡¿…]+$', '', 'g')), 'áéíóú', 'aeiou'), '_', ' '), '\s+', ' ', 'g') IN {_in(t.HALLUCINATIONS)} AS dropped FROM b""")
def _(spark, sf):
    turn = F.col("turn") % 4
    x = F.when(turn == 0, F.concat(F.lit("["), "text", F.lit("]"))).when(turn == 1, "¡Gracias por ver el vídeo!").when(turn == 2, " BLANK_AUDIO. ").otherwise(F.col("text"))
    return p.table(spark, sf, "conversations").select("conv_id", "turn", t.is_hallucination(x).alias("dropped"))


@query("t09_repetition", r"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN repeat('no way ', (turn % 5 + 2)::BIGINT) || text ELSE text END AS x FROM conversations),
b AS (SELECT *, list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '') AS w FROM a)
SELECT conv_id, turn, len(list_filter(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, len(w) - 4 * n + 2), lambda i:
  w[i:i + n - 1] = w[i + n:i + 2 * n - 1] AND w[i:i + n - 1] = w[i + 2 * n:i + 3 * n - 1] AND w[i:i + n - 1] = w[i + 3 * n:i + 4 * n - 1]))), lambda x: x)) > 0 AS looped FROM b""")
def _(spark, sf):
    x = F.when(F.col("turn") % 2 == 0, F.concat(F.repeat(F.lit("no way "), (F.col("turn") % 5 + 2).cast("int")), "text")).otherwise(F.col("text"))
    return p.table(spark, sf, "conversations").select("conv_id", "turn", t.is_loop(x).alias("looped"))


@query("t10_wer_words", r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}'']', '', 'g')), lambda w: w <> ''), ' ') AS words FROM documents""")
def _(spark, sf):
    return p.table(spark, sf, "documents").select("doc_id", F.array_join(t.wer_words(F.col("text")), " ").alias("words"))


@query("t16_citations", r"""WITH a AS (SELECT conv_id, turn, text || ' [seg:' || turn || '] and [seg:' || (turn % 2) || '] or [seg:' || turn || '] [seg:open' AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN turn = turn % 2 THEN turn::VARCHAR ELSE turn || ',' || (turn % 2) END AS cited FROM a""")
def _(spark, sf):
    x = F.concat("text", F.lit(" [seg:"), "turn", F.lit("] and [seg:"), F.col("turn") % 2, F.lit("] or [seg:"), "turn", F.lit("] [seg:open"))
    return p.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(t.citations(x), ",").alias("cited"))


@query("t17_cited_transcript", r"""SELECT meeting_id, string_agg('[seg:' || seg_id || '] (' || (start_ms // 60000) || ':' || lpad(((start_ms // 1000) % 60)::VARCHAR, 2, '0') || ') ' || role || ': ' || x, chr(10) ORDER BY start_ms, seg_id) AS transcript
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM segments) WHERE x <> '' GROUP BY meeting_id""", "segments")
def _(spark, sf):
    line = F.concat(F.lit("[seg:"), "seg_id", F.lit("] ("), t.minutes_seconds(F.col("start_ms"), False), F.lit(") "), "role", F.lit(": "), t.trimmed(F.col("text")))
    s = p.segments(spark, sf).filter(t.trimmed(F.col("text")) != "")
    return catalog.joined_text(s, "meeting_id", ["start_ms", "seg_id"], line, "\n", "transcript")


@query("t19_truncated", f"""SELECT doc_id, md5(CASE WHEN length(text) > 6000 THEN left(text, 4000) || '{t.TRUNCATED}' || right(text, 2000) ELSE text END) AS shortened FROM documents""")
def _(spark, sf):
    return p.table(spark, sf, "documents").select("doc_id", F.md5(t.head_and_tail(F.col("text"))).alias("shortened"))


@query("t20_clock", """SELECT seg_id, lpad((end_ms // 60000)::VARCHAR, 2, '0') || ':' || lpad(((end_ms // 1000) % 60)::VARCHAR, 2, '0') AS padded,
  CASE WHEN end_ms // 1000 < 60 THEN (end_ms // 1000) || 's' ELSE (end_ms // 60000) || 'm ' || lpad(((end_ms // 1000) % 60)::VARCHAR, 2, '0') || 's' END AS spoken FROM segments""", "segments")
def _(spark, sf):
    return p.segments(spark, sf).select("seg_id", t.minutes_seconds(F.col("end_ms")).alias("padded"), t.spoken_length(F.col("end_ms")).alias("spoken"))


@query("t23_titles", "SELECT meeting_id, 'Call of ' || strftime(make_timestamp(started_ms * 1000), '%Y-%m-%d') AS title FROM meetings", "meetings")
def _(spark, sf):
    return p.meetings(spark, sf).select("meeting_id", t.title_from(F.lit("Call of {date}"), F.col("started_ms")).alias("title"))


@query("t24_language_instruction", """SELECT lang, CASE WHEN lang = 'es' THEN 'Responde SIEMPRE en español neutro.' WHEN lang = 'en' THEN 'Always respond in English.'
  ELSE 'Always respond in the same language as the meeting transcript (ISO code: ' || lang || ').' END AS instruction FROM (SELECT DISTINCT lang FROM documents)""")
def _(spark, sf):
    return p.table(spark, sf, "documents").select("lang").distinct().select("lang", t.language_instruction(F.col("lang")).alias("instruction"))


@query("t27_thoughts", r"""SELECT conv_id, turn, regexp_replace(regexp_replace(x, '<think>.*?(</think>|\z)', '', 'gs'), '^\s+', '') AS answer FROM (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<think>a' || chr(10) || 'b</think>' || chr(10) || ' ' || text ELSE '<think>' || text END AS x FROM conversations)""")
def _(spark, sf):
    x = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>a\nb</think>\n "), "text")).otherwise(F.concat(F.lit("<think>"), "text"))
    return p.table(spark, sf, "conversations").select("conv_id", "turn", t.without_thoughts(x).alias("answer"))


@query("t30_escaped", """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM pages""")
def _(spark, sf):
    return p.table(spark, sf, "pages").select("page_id", F.md5(t.html_escaped(F.col("html"))).alias("escaped"))


@query("t32_samples", """SELECT seg_id, (floor(16000 * end_ms / 1000) * 2)::BIGINT AS samples, end_ms AS back_ms, greatest(start_ms - end_ms, 0)::BIGINT AS nothing FROM segments""", "segments")
def _(spark, sf):
    n = t.samples_of(F.col("end_ms"), F.lit(16000), F.lit(2))
    return p.segments(spark, sf).select("seg_id", n.cast("long").alias("samples"), t.ms_of(n, F.lit(16000), F.lit(2)).cast("long").alias("back_ms"), t.duration(F.col("end_ms"), F.col("start_ms")).cast("long").alias("nothing"))


@query("st16_stop_sequences", """SELECT doc_id, md5(CASE WHEN least(CASE WHEN instr(text, '. ') > 0 THEN instr(text, '. ') END, CASE WHEN instr(text, chr(10)) > 0 THEN instr(text, chr(10)) END) IS NULL THEN text
  ELSE substr(text, 1, least(CASE WHEN instr(text, '. ') > 0 THEN instr(text, '. ') END, CASE WHEN instr(text, chr(10)) > 0 THEN instr(text, chr(10)) END) - 1) END) AS cut FROM documents""")
def _(spark, sf):
    return p.table(spark, sf, "documents").select("doc_id", F.md5(t.cut_at_stop(F.col("text"), (". ", "\n"))).alias("cut"))


# --- vectors ----------------------------------------------------------------------------------


@query("v01_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    e = p.table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(v.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def _vector_digest(v) -> Column:
    """A whole vector, in whole ten-thousandths."""
    return F.md5(F.array_join(F.transform(v, lambda x: F.round(x * 10000).cast("long").cast("string")), ","))


_DIGEST = "md5(array_to_string(list_transform({}, lambda x: round(x * 10000)::BIGINT::VARCHAR), ','))"


@query("v02_normalised", f"""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) AS size FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x / size) * (x / size))), 6) AS squared, {_DIGEST.format("list_transform(e, lambda y: y / size)")} AS unit FROM n""")
def _(spark, sf):
    u = v.normalised(F.col("embedding"))
    return p.table(spark, sf, "embeddings").select("vec_id", F.round(v.dot(u, u), 6).alias("squared"), _vector_digest(u).alias("unit"))


@query("a12_centroids", f"""WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x, count(*) AS n FROM embeddings, range(1, 65) r(i) GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS c, sqrt(sum(x * x)) AS size FROM m GROUP BY label)
SELECT label, n, {_DIGEST.format("list_transform(c, lambda y: y / size)")} AS centroid FROM c""")
def _(spark, sf):
    return v.centroids(p.table(spark, sf, "embeddings"), ["label"], "embedding").select("label", "n", _vector_digest("centroid").alias("centroid"))


@query("a13_best_centroid", """WITH m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, m.label AS best, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS sim FROM embeddings, m)
SELECT vec_id, best, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, best) AS rn FROM s) WHERE rn = 1""")
def _(spark, sf):
    e = p.table(spark, sf, "embeddings")
    return v.best_match(e, v.centroids(e, ["label"], "embedding", 1), "embedding", "centroid", "label").select("vec_id", "best", "sim")


@query("j09_similar_centroids", """WITH m AS (SELECT vec_id // 4 AS g, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
c AS (SELECT g, list(x ORDER BY i) AS v FROM m GROUP BY g)
SELECT a.g AS a, b.g AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM c a JOIN c b ON a.g < b.g WHERE list_cosine_similarity(a.v, b.v) >= 0.3""")
def _(spark, sf):
    e = p.table(spark, sf, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 4))
    c = v.centroids(e, ["g"], "embedding", 1)
    return similar.similar_pairs(c, "g", "centroid", 0.3).withColumn("similarity", F.round("similarity", 6))


@query("o03_speaker_spans", """WITH a AS (SELECT meeting_id, role, turn, start_ms, end_ms, turn - row_number() OVER (PARTITION BY meeting_id, role ORDER BY turn) AS island FROM segments),
s AS (SELECT meeting_id, role AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM a GROUP BY meeting_id, role, island)
SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, speaker, end_ms) - 1 AS place FROM s""", "segments")
def _(spark, sf):
    return ordered.speaker_spans(p.segments(spark, sf).withColumnRenamed("role", "speaker"), "meeting_id", "turn")


@query("v05_downmix", f"SELECT vec_id, {_DIGEST.format('list_transform(range(1, len(embedding) // 2 + 1), lambda i: (embedding[2 * i - 1]::DOUBLE + embedding[2 * i]) / 2)')} AS mono, len(embedding) // 2 AS frames FROM embeddings")
def _(spark, sf):
    m = v.mono(F.col("embedding"), 2)
    return p.table(spark, sf, "embeddings").select("vec_id", _vector_digest(m).alias("mono"), F.size(m).cast("long").alias("frames"))


@query("v07_fixed_windows", f"""SELECT vec_id, {_DIGEST.format("embedding[13:52]::DOUBLE[]")} AS cropped, {_DIGEST.format("list_concat(embedding::DOUBLE[], list_transform(range(36), lambda x: 0::DOUBLE))")} AS padded FROM embeddings""")
def _(spark, sf):
    e = v.doubles(F.col("embedding"))
    return p.table(spark, sf, "embeddings").select("vec_id", _vector_digest(v.fixed_window(e, 40)).alias("cropped"), _vector_digest(v.fixed_window(e, 100)).alias("padded"))


@query("v03_merged_centroids", f"""WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] * 3 + z[2]) / 4) AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
n AS (SELECT vec_id, m, sqrt(list_sum(list_transform(m, lambda y: y * y))) AS size FROM p)
SELECT vec_id, {_DIGEST.format("list_transform(m, lambda y: y / size)")} AS merged FROM n""")
def _(spark, sf):
    e = p.table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", _vector_digest(v.weighted_mean(F.col("embedding"), F.lit(3), F.col("other"), F.lit(1))).alias("merged"))


@query("s06_pcm_samples", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: trunc(greatest(least(x::DOUBLE * 4, 1), -1) * 32767)::BIGINT::VARCHAR), ',') AS pcm FROM embeddings")
def _(spark, sf):
    loud = F.transform(v.doubles(F.col("embedding")), lambda x: x * 4)
    return p.table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(v.pcm16(loud), lambda x: x.cast("string")), ",").alias("pcm"))


# --- clustering, evaluation and automata: ordered folds, no SQL twin ---------------------------

#: Vectors of a session, so that sessions grow in number and not in length.
SESSION = 1000


@query("st07_online_speakers")
def _(spark, sf):
    e = p.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / SESSION).alias("session"), F.col("vec_id").alias("seq"), "embedding")
    return cluster.online_speakers(e, "session", "seq", "embedding")


@query("st10_refined_speakers")
def _(spark, sf):
    e = p.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / SESSION).alias("session"), "vec_id", F.col("label").alias("slot"), "embedding")
    return cluster.refined_speakers(e, "session", "slot", "embedding").select("session", "vec_id", "slot", "refined")


def _automaton(level: str, start: float, start_frames: int, end: float, end_frames: int) -> str:
    """The two-threshold automaton frame by frame, as recursion over a session's rows."""
    hit = f"(CASE WHEN r.voiced THEN e.level <= {end} ELSE e.level >= {start} END)"
    flips = f"({hit} AND r.run + 1 >= CASE WHEN r.voiced THEN {end_frames} ELSE {start_frames} END)"
    return f"""WITH e AS (SELECT session_id, seq, {level} AS level FROM session_events),
r AS (SELECT session_id, -1::BIGINT AS seq, false AS voiced, 0 AS run FROM e GROUP BY session_id
  UNION ALL SELECT e.session_id, e.seq, CASE WHEN {flips} THEN NOT r.voiced ELSE r.voiced END, CASE WHEN {hit} AND NOT {flips} THEN r.run + 1 ELSE 0 END
  FROM r JOIN e ON e.session_id = r.session_id AND e.seq = r.seq + 1)
"""


def _recursive(sql: str) -> str:
    return p.with_sql(sql, "session_events").replace("WITH ", "WITH RECURSIVE ", 1)


@query("st05_voice_activity", _recursive(_automaton("rms", 0.02, 3, 0.01, 10) + "SELECT session_id AS session, seq, voiced FROM r WHERE seq >= 0"))
def _(spark, sf):
    return sessions.hysteresis(p.session_events(spark, sf), "session_id", "seq", "rms", 0.02, 3, 0.01, 10)


@query("st19_recording_states", """WITH RECURSIVE a AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
    CASE event_id % 7 WHEN 0 THEN 'START_REQUESTED' WHEN 1 THEN 'STREAMING_STARTED' WHEN 2 THEN 'STREAMING_PAUSED' WHEN 3 THEN 'STREAMING_RESUMED' WHEN 4 THEN 'STOP_REQUESTED' WHEN 5 THEN 'STREAMING_STOPPED' ELSE 'BACKEND_ERROR' END AS act FROM events),
t(s, act, n) AS (VALUES """ + ", ".join(f"('{s}', '{a}', '{n}')" for (s, a), n in sessions.TRANSITIONS.items()) + """),
r AS (SELECT session_id, 0::BIGINT AS i, 'idle' AS state FROM a GROUP BY session_id
  UNION ALL SELECT r.session_id, a.i, coalesce(t.n, r.state) FROM r JOIN a ON a.session_id = r.session_id AND a.i = r.i + 1 LEFT JOIN t ON t.s = r.state AND t.act = a.act)
SELECT session_id, arg_max(state, i) AS state FROM r GROUP BY session_id""")  # fmt: skip
def _(spark, sf):
    kinds = ("START_REQUESTED", "STREAMING_STARTED", "STREAMING_PAUSED", "STREAMING_RESUMED", "STOP_REQUESTED", "STREAMING_STOPPED", "BACKEND_ERROR")
    act = F.element_at(F.array(*(F.lit(x) for x in kinds)), (F.col("event_id") % 7 + 1).cast("int"))
    e = p.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", act.alias("act"))
    acts = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "act"))), lambda x: x["act"])
    return e.groupBy("session_id").agg(acts.alias("acts")).select("session_id", sessions.final_state(F.col("acts")).alias("state"))


def _wer_pairs(spark, sf):
    c = p.table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.select("conv_id", "turn", t.wer_words(F.col("text")).alias("ref"), F.lead("text").over(w).alias("other"))
    return pairs.filter("other IS NOT NULL").select("conv_id", "turn", evaluate.error_counts(F.col("ref"), t.wer_words(F.col("other"))).alias("e")).select("conv_id", "turn", "e.*")


# A cell of the cost table is one number: cost, substitutions, deletions and insertions, 16 bits each.
_WORD_ERRORS = r"""
WITH w AS (
  SELECT *, list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}'']', '', 'g')), lambda w: w <> '') AS r FROM conversations),
pairs AS (SELECT *, lead(r) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM w),
cells AS (
  SELECT conv_id, turn, len(r) AS n, len(h) AS m,
         list_reduce(list_transform(range(1, len(r) + 1), lambda i: [i]), lambda above, i:
           list_reduce(list_transform(range(1, len(h) + 1), lambda j: [j]), lambda done, j: list_append(done,
             CASE WHEN least(above[j[1]] + (h[j[1]] <> r[i[1]])::BIGINT * 281479271677952, above[j[1] + 1] + 281474976776192) >> 48 > (done[-1] + 281474976710657) >> 48 THEN done[-1] + 281474976710657
                  WHEN (above[j[1]] + (h[j[1]] <> r[i[1]])::BIGINT * 281479271677952) >> 48 <= (above[j[1] + 1] + 281474976776192) >> 48 THEN above[j[1]] + (h[j[1]] <> r[i[1]])::BIGINT * 281479271677952
                  ELSE above[j[1] + 1] + 281474976776192 END),
             [above[1] + 281474976776192]),
           list_transform(range(0, len(h) + 1), lambda j: j * 281474976710657))[-1] AS x
  FROM pairs WHERE h IS NOT NULL),
errors AS (
  SELECT conv_id, turn, n::INTEGER AS reference_words, m::INTEGER AS hypothesis_words, ((x >> 32) & 65535)::INTEGER AS substitutions, ((x >> 16) & 65535)::INTEGER AS deletions, (x & 65535)::INTEGER AS insertions FROM cells)
"""


@query("t11_word_errors", _WORD_ERRORS + "SELECT * FROM errors")
def _(spark, sf):
    return _wer_pairs(spark, sf)


_RATE = "CASE WHEN reference_words > 0 THEN (substitutions + deletions + insertions) / reference_words WHEN substitutions + deletions + insertions > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS wer"
_SUMS = ", ".join(f"sum({x})::BIGINT AS {x}" for x in ("reference_words", "hypothesis_words", "substitutions", "deletions", "insertions"))


@query("a09_wer_by_conversation", _WORD_ERRORS + f", sums AS (SELECT conv_id, {_SUMS} FROM errors GROUP BY conv_id) SELECT *, {_RATE} FROM sums")
def _(spark, sf):
    return evaluate.rolled_up(_wer_pairs(spark, sf), "conv_id")


@query("ev1_wer_report", _WORD_ERRORS + f""", clips AS (SELECT *, reference_words / 3.0::DOUBLE AS audio, reference_words / 30.0::DOUBLE + (substitutions + deletions + insertions) / 10.0::DOUBLE AS elapsed FROM errors),
ranked AS (SELECT *, elapsed / greatest(audio, 1e-6::DOUBLE) AS rtf FROM clips),
placed AS (SELECT *, row_number() OVER (ORDER BY rtf) - 1 AS i, count(*) OVER () AS n FROM ranked),
sums AS (
  SELECT {_SUMS}, count(*) AS clips, round(sum(audio), 6) AS audio_seconds, round(sum(elapsed), 6) AS elapsed_seconds,
         round(max(CASE WHEN i = floor((n - 1) * 0.5 + 0.5) THEN rtf END), 9) AS rtf_p50, round(max(CASE WHEN i = floor((n - 1) * 0.95 + 0.5) THEN rtf END), 9) AS rtf_p95 FROM placed)
SELECT *, {_RATE} FROM sums""")
def _(spark, sf):
    """Each pair as a clip; a word lasts a third of a second, and an error takes a tenth more to hear."""
    words = F.col("reference_words")
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    clips = _wer_pairs(spark, sf).withColumn("audio_seconds", words / 3.0).withColumn("elapsed_seconds", words / 30.0 + errors / 10.0)
    return evaluate.report(clips).withColumns({x: F.round(x, n) for x, n in (("audio_seconds", 6), ("elapsed_seconds", 6), ("rtf_p50", 9), ("rtf_p95", 9))})


# --- answers of models, documents ---------------------------------------------------------------


def _answers(spark, sf):
    """Documents as answers of a model: prose, a fenced JSON object with items of all types, and another one after it."""
    text = F.coalesce("text", F.lit(""))
    whole = F.to_json(F.struct(text.alias("t")))
    quoted = F.substring(whole, F.lit(6), F.length(whole) - 6)
    raw = F.concat(
        F.lit('Sure!\n```json\n{"keyPoints": ["a", 3, null, {"b": 1}, "'), "lang", F.lit('"], "actionItems": [{"task": "call", "owner": "'), "source", F.lit('"}, {"owner": "x"}, {"task": 5}, "y"], "more": {"deep": '),
        quoted, F.lit("}"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit(', "summary": '), quoted)).otherwise(""), F.when(F.col("doc_id") % 7 != 0, '}\n``` {"summary": "no"}').otherwise(""),
    )
    template = F.when(F.col("lang") == "en", "general").when(F.col("lang") == "de", "lecture").otherwise("other")
    return p.table(spark, sf, "documents").select("doc_id", template.alias("template"), raw.alias("raw"), quoted.alias("quoted"))


_ANSWERS = """WITH a AS (SELECT doc_id, lang, source, text, CASE lang WHEN 'en' THEN 'general' WHEN 'de' THEN 'lecture' ELSE 'other' END AS template,
  CASE WHEN doc_id % 7 = 0 THEN 'no JSON object found in response' WHEN doc_id % 5 = 0 THEN 'missing required field `summary`' WHEN lang NOT IN ('en', 'de') THEN 'unknown template: other' END AS error FROM documents)
"""


@query("t13_first_objects", """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN md5('{"keyPoints": ["a", 3, null, {"b": 1}, "' || lang || '"], "actionItems": [{"task": "call", "owner": "' || source || '"}, {"owner": "x"}, {"task": 5}, "y"], "more": {"deep": '
  || to_json(text)::VARCHAR || '}' || CASE WHEN doc_id % 5 <> 0 THEN ', "summary": ' || to_json(text)::VARCHAR ELSE '' END || '}') END AS object FROM documents""")
def _(spark, sf):
    return _answers(spark, sf).select("doc_id", F.md5(payload.first_object(F.col("raw"))).alias("object"))


@query("t14_typed_payloads", _ANSWERS + """SELECT doc_id, error, CASE WHEN error IS NULL THEN md5(text) END AS summary, CASE WHEN error IS NULL AND template = 'general' THEN 'a,' || lang END AS points,
  CASE WHEN error IS NULL AND template = 'general' THEN 'call/' || source END AS tasks, CASE WHEN error IS NULL AND template = 'lecture' THEN 0::BIGINT END AS definitions FROM a""")
def _(spark, sf):
    df = payload.with_payload(_answers(spark, sf), F.col("template"), F.col("raw"), "p").select("doc_id", "p.error", "p.payload.*")
    tasks = F.array_join(F.transform("actionItems", lambda x: F.concat_ws("/", x["task"], x["owner"])), ",")
    count = F.when(F.col("definitions").isNotNull(), F.size("definitions").cast("long"))
    return df.select("doc_id", "error", F.md5("summary").alias("summary"), F.array_join("keyPoints", ",").alias("points"), tasks.alias("tasks"), count.alias("definitions"))


def _named(spark, sf):
    s = catalog.labelled_segments(p.segments(spark, sf), p.speakers(spark, sf))
    return s.withColumn("speaker", F.when(F.col("turn") % 5 != 3, F.col("speaker")))  # some turns have no speaker


_NAMED = r"""WITH named AS (
  SELECT s.*, regexp_replace(s.text, '^\s+|\s+$', '', 'g') AS x, CASE WHEN s.turn % 5 <> 3 THEN coalesce(p.label, 'Speaker ' || (p.slot + 1)) END AS speaker
  FROM segments s LEFT JOIN speakers p ON s.meeting_id = p.meeting_id AND s.role = p.role)
"""


@query("t18_transcripts", _NAMED + """SELECT meeting_id, md5(string_agg(coalesce(speaker, 'Speaker') || ': ' || x, chr(10) ORDER BY start_ms, seg_id)) AS plain,
  md5(string_agg('[seg:' || seg_id || '] (' || (start_ms // 60000) || ':' || lpad(((start_ms // 1000) % 60)::VARCHAR, 2, '0') || ') ' || coalesce(speaker, 'Speaker') || ': ' || x, chr(10) ORDER BY start_ms, seg_id)) AS cited
FROM named WHERE x <> '' GROUP BY meeting_id""", "segments", "speakers")
def _(spark, sf):
    s = _named(spark, sf).filter(t.trimmed(F.col("text")) != "")
    plain = render.block(s, "meeting_id", ["start_ms", "seg_id"], render.transcript_line(F.col("text"), F.col("speaker")), "plain")
    cited = render.block(s, "meeting_id", ["start_ms", "seg_id"], render.cited_line(F.col("seg_id"), F.col("start_ms"), F.col("text"), F.col("speaker")), "cited")
    return plain.join(cited, "meeting_id").select("meeting_id", F.md5("plain").alias("plain"), F.md5("cited").alias("cited"))


#: The variants of a summary, dealt to meetings in turn; every ninth has none.
_VARIANTS = (*payload.FIELDS, payload.FREE_TEXT, payload.CUSTOM)


def _digests(spark, sf):
    """One summary a meeting, of all variants in turn, with its title and number of segments in each section."""
    m = p.meetings(spark, sf).withColumn("place", (F.col("meeting_id") % (len(_VARIANTS) + 1)).cast("int")).filter(F.col("place") < len(_VARIANTS))
    n = F.col("segment_count").cast("string")
    with_n = lambda x: F.concat(F.lit(f"{x} "), n)
    none = F.lit(None).cast("string")
    task = lambda t, owner, due: F.struct(t.alias("task"), owner.alias("owner"), due.alias("due"))
    quote = lambda who, q, x: F.struct(F.lit(who).alias("speaker"), q.alias("quote"), x.alias("context"))
    made = {
        "list": lambda f: F.array(F.lit(f"{f} **one**"), with_n(f)),
        "text": with_n,
        "tasks": lambda f: F.array(task(with_n("call"), F.lit("Ana"), F.lit("May")), task(F.lit("write"), none, none)),
        "quotes": lambda f: F.array(quote("Bo", with_n("Yes"), F.lit("end")), quote("Cy", F.lit("No"), none)),
        "definitions": lambda f: F.array(F.struct(with_n("term").alias("term"), F.lit("what it is").alias("definition"))),
    }
    whole = F.to_json(F.struct(F.concat("title", F.lit(" went well.")).alias("summary"), *(made[kind](f).alias(f) for f, kind in payload.KINDS.items())))
    template = F.element_at(F.array(*map(F.lit, _VARIANTS)), F.col("place") + 1)
    raw = F.when(template.isin(payload.FREE_TEXT, payload.CUSTOM), F.concat(F.lit("# Free "), n, F.lit("\n- text"))).otherwise(whole)
    parsed = payload.with_payload(m, template, raw, "parsed").withColumn("template", template)
    return parsed.select("meeting_id", "template", F.col("parsed.payload").alias("payload"))


def _md_text(name: str) -> str:
    """A digest's Markdown, with {title} and {n} in the place of what is the meeting's own."""
    if name == payload.FREE_TEXT:
        return "# Free {n}\n- text\n\n"
    if name == payload.CUSTOM:
        return ""
    out = "{title} went well.\n\n"
    for kind, f in payload.FIELDS[name]:
        h = render.HEADINGS[f]
        out += {
            "list": f"### {h}\n\n- {f} **one**\n- {f} {{n}}\n\n",
            "text": f"**{h}:** {f} {{n}}\n\n",
            "tasks": f"### {h}\n\n- [ ] call {{n}}{ {'general': ' — *Ana* (due: May)', 'oneOnOne': ' — *Ana*'}.get(name, '') }\n- [ ] write\n\n",
            "quotes": f'### {h}\n\n> "Yes {{n}}"\n> — Bo (end)\n\n> "No"\n> — Cy\n\n',
            "definitions": f"### {h}\n\n- **term {{n}}**: what it is\n\n",
        }[kind]
    return out


def _plain_text(name: str) -> str:
    if name == "general":
        out = "{title} went well.\n\n"
        for kind, f in payload.FIELDS[name]:
            items = ("call {n} (Ana) [due: May]", "write") if kind == "tasks" else (f"{f} **one**", f"{f} {{n}}")
            out += render.HEADINGS[f].upper() + "\n" + "".join(f"  - {x}\n" for x in items) + "\n"
        return out
    lines = []
    for line in _md_text(name).splitlines():
        line = line.lstrip("#")
        line = line.removeprefix("**") if line.startswith("**") else line
        line = line.removesuffix("**") if line.endswith("**") else line
        for mark in ("- [ ] ", "- ", "> "):
            line = line.removeprefix(mark)
        lines.append(line.strip())
    return "".join(x + "\n" for x in lines)


def _copied_text(name: str) -> str:
    if name in (payload.FREE_TEXT, payload.CUSTOM):
        return "# Free {n}\n- text"
    out = ["{title} went well."]
    for kind, f in payload.FIELDS[name]:
        h = render.HEADINGS[f]
        out += {
            "list": [f"\n{h}", f"• {f} **one**", f"• {f} {{n}}"],
            "text": [f"\nDeal stage: {f} {{n}}"] if f == "dealStageIndicator" else [f"\n{h}", f"{f} {{n}}"],
            "tasks": [f"\n{h}", "• call {n} (Ana) — May", "• write"],
            "quotes": [f"\n{h}", '• "Yes {n}" — Bo', '• "No" — Cy'],
            "definitions": [f"\n{h}", "• term {n}: what it is"],
        }[kind]
    return "\n".join(out)


def _by_variant(of) -> str:
    """What each variant's meetings have, as SQL."""
    text = lambda x: "'" + of(x).replace("'", "''").replace("{n}", "' || segment_count || '").replace("{title}", "' || title || '") + "'"
    return f"CASE meeting_id % {len(_VARIANTS) + 1} " + " ".join(f"WHEN {i} THEN {text(x)}" for i, x in enumerate(_VARIANTS)) + " END"


_EXPORT = _NAMED.rstrip() + r""",
m AS (SELECT *, CASE WHEN duration_ms // 1000 < 60 THEN (duration_ms // 1000) || 's' ELSE (duration_ms // 60000) || 'm ' || lpad(((duration_ms // 1000) % 60)::VARCHAR, 2, '0') || 's' END AS dur,
  {digests} AS digest FROM meetings),
said AS (SELECT meeting_id, string_agg({line}, '' ORDER BY start_ms, seg_id) AS said FROM (SELECT *, '[' || lpad((start_ms // 60000)::VARCHAR, 2, '0') || ':' || lpad(((start_ms // 1000) % 60)::VARCHAR, 2, '0') || ']' AS ts FROM named WHERE x <> '') GROUP BY meeting_id),
people AS (SELECT meeting_id, string_agg(coalesce(label, 'Speaker ' || (slot + 1)), ', ' ORDER BY slot) AS people FROM speakers GROUP BY meeting_id),
noted AS (SELECT meeting_id, string_agg({note}, '' ORDER BY timestamp_ms, note_id) AS noted FROM (SELECT *, '[' || CASE WHEN timestamp_ms // 60000 < 10 THEN '0' ELSE '' END || (timestamp_ms // 60000) || ':' || lpad(((timestamp_ms // 1000) % 60)::VARCHAR, 2, '0') || ']' AS ts FROM notes) GROUP BY meeting_id)
SELECT meeting_id, md5({body}) AS body FROM m LEFT JOIN said USING (meeting_id) LEFT JOIN people USING (meeting_id) LEFT JOIN noted USING (meeting_id)"""


def _filled(**parts: str) -> str:
    sql = _EXPORT
    for name, x in parts.items():
        sql = sql.replace("{" + name + "}", x)
    return sql


_MARKDOWN = _filled(
    digests=_by_variant(_md_text),
    line="'**' || ts || coalesce(' ' || speaker || ':**', '**') || ' ' || x || chr(10) || chr(10)", note="'- **' || ts || '** ' || text || chr(10)",
    body="""'# ' || title || chr(10) || chr(10) || '**Date:** ' || started_ms || '  ' || chr(10) || '**Duration:** ' || dur || '  ' || chr(10) || '**Language:** ?  ' || chr(10) || '**Segments:** ' || segment_count || chr(10) || chr(10)
  || coalesce('**Participants:** ' || people || chr(10) || chr(10), '') || '---' || chr(10) || chr(10) || coalesce('## Summary' || chr(10) || chr(10) || digest || '---' || chr(10) || chr(10), '')
  || '## Transcript' || chr(10) || chr(10) || coalesce(said, '') || coalesce('---' || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || noted || chr(10), '')""",
)
_PLAIN = _filled(
    digests=_by_variant(_plain_text),
    line="ts || coalesce(' ' || speaker || ':', '') || ' ' || x || chr(10)", note="ts || ' ' || text || chr(10)",
    body="""title || chr(10) || repeat('=', length(title)) || chr(10) || chr(10) || 'Date:     ' || started_ms || chr(10) || 'Duration: ' || dur || chr(10) || 'Language: ?' || chr(10) || 'Segments: ' || segment_count || chr(10)
  || coalesce('Participants: ' || people || chr(10), '') || coalesce(chr(10) || chr(10) || 'SUMMARY' || chr(10) || '-------' || chr(10) || chr(10) || digest, '')
  || chr(10) || chr(10) || 'TRANSCRIPT' || chr(10) || '----------' || chr(10) || chr(10) || coalesce(said, '') || coalesce(chr(10) || chr(10) || 'NOTES' || chr(10) || '-----' || chr(10) || chr(10) || noted, '')""",
)


def _exports(spark, sf, style):
    m = p.meetings(spark, sf).select("meeting_id", "title", F.col("started_ms").alias("started_at"), "duration_ms", F.lit(None).cast("string").alias("language"), "segment_count")
    named = _named(spark, sf).withColumn("speaker", F.col("speaker"))
    return render.exports(m, named, p.speakers(spark, sf), p.notes(spark, sf), _digests(spark, sf), style).select("meeting_id", F.md5("body").alias("body"))


@query("t28_markdown_exports", _MARKDOWN, "meetings", "speakers", "notes")
def _(spark, sf):
    return _exports(spark, sf, "markdown")


@query("t28_text_exports", _PLAIN, "meetings", "speakers", "notes")
def _(spark, sf):
    return _exports(spark, sf, "text")


@query("t29_clipboard_texts", f"SELECT meeting_id, {_by_variant(_copied_text)} AS copied FROM meetings WHERE meeting_id % {len(_VARIANTS) + 1} < {len(_VARIANTS)}", "meetings")
def _(spark, sf):
    return _digests(spark, sf).select("meeting_id", render.clipboard_text(F.col("template"), F.col("payload")).alias("copied"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("t25_summary_prompts", f"""SELECT doc_id, md5('<|im_start|>system' || chr(10) || CASE lang WHEN 'en' THEN {_sql(render.ROLES["general"])} WHEN 'de' THEN {_sql(render.ROLES["lecture"])} ELSE {_sql(render.ROLES["interview"])} END || ' ' ||
  CASE WHEN lang = 'es' THEN 'Responde SIEMPRE en español neutro.' WHEN lang = 'en' THEN 'Always respond in English.' ELSE 'Always respond in the same language as the meeting transcript (ISO code: ' || lang || ').' END || chr(10) || {_sql(render.ONLY_JSON)} || chr(10) || chr(10) ||
  CASE lang WHEN 'en' THEN {_sql(render.schema_text("general"))} WHEN 'de' THEN {_sql(render.schema_text("lecture"))} ELSE {_sql(render.schema_text("interview"))} END || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Transcript:' || chr(10) || '---' || chr(10) ||
  replace(text, '</s>', '') || chr(10) || '---' || CASE WHEN doc_id % 2 = 0 THEN {_sql(render.NOTES_HEAD)} || source || chr(10) || '---' ELSE '' END || {_sql(render.RETURN_JSON)} ||
  CASE WHEN doc_id % 3 = 0 THEN {_sql(render.NOT_PARSED[0])} || 'bad' || {_sql(render.NOT_PARSED[1])} ELSE '' END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt FROM documents""")
def _(spark, sf):
    template = F.when(F.col("lang") == "en", "general").when(F.col("lang") == "de", "lecture").otherwise("interview")
    prompt = render.summary_prompt(template, F.concat("text", F.lit("</s>")), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("<|im_end|>"))), F.when(F.col("doc_id") % 3 == 0, "bad"))
    return p.table(spark, sf, "documents").select("doc_id", F.md5(prompt).alias("prompt"))


@query("t26_chat_prompts", """SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS prompt FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 20 AND role <> 'system' GROUP BY conv_id""")
def _(spark, sf):
    turns = ordered.last_rows(p.table(spark, sf, "conversations"), ["conv_id"], ["turn"], 20).filter("role <> 'system'")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", t.without_control_tokens(F.col("text")).alias("content"))))
    return turns.groupBy("conv_id").agg(said.alias("m")).select("conv_id", F.md5(render.chat_prompt(F.col("m"))).alias("prompt"))


# --- scalars of validation and time -------------------------------------------------------------


@query("t03_labels", r"""SELECT doc_id, nullif(x, '') AS label, length(x) <= 80 AS fits FROM (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '  ' WHEN doc_id % 3 = 1 THEN ' ' || source || ' ' ELSE text END, '^\s+|\s+$', '', 'g') AS x FROM documents)""")
def _(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "source", F.lit(" "))).otherwise(F.col("text"))
    label, fits = t.normal_label(raw)
    return p.table(spark, sf, "documents").select("doc_id", label.alias("label"), fits.alias("fits"))


@query("t33_frames", "SELECT user_id, event_id, (event_id * 7) // 2 AS frames, (((event_id * 7) // 2) * 1000) // 16000 AS ms, CASE WHEN value > 50 AND event_id > 0 THEN round(value / event_id, 6) ELSE 0 END AS rtf, greatest(event_id - 500, 0) * 10 AS at_ms FROM events")
def _(spark, sf):
    n = F.col("event_id") * 7
    e = p.table(spark, sf, "events")
    audio = F.when(F.col("value") > 50, F.col("event_id")).otherwise(0)
    return e.select("user_id", "event_id", t.frames_of(n, F.lit(2)).alias("frames"), t.ms_of(n, F.lit(16000), F.lit(2)).cast("long").alias("ms"), F.round(t.real_time_factor(F.col("value"), audio), 6).alias("rtf"), chunks.from_centiseconds(F.col("event_id") - 500).alias("at_ms"))


@query("t35_identifiers", r"""SELECT doc_id, regexp_matches(x, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AS valid, CASE WHEN doc_id % 2 = 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE source END AS day FROM (
  SELECT *, md5(source) AS h, CASE WHEN doc_id % 3 = 0 THEN md5(source) ELSE substr(md5(source), 1, 8) || '-' || substr(md5(source), 9, 4) || '-' || substr(md5(source), 13, 4) || '-' || substr(md5(source), 17, 4) || '-' || substr(md5(source), 21) END AS x FROM documents)""")
def _(spark, sf):
    h = F.md5("source")
    x = F.when(F.col("doc_id") % 3 == 0, h).otherwise(F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
    day = F.when(F.col("doc_id") % 2 == 0, F.format_string("2024-01-%02dT10:00:00Z", F.col("doc_id") % 28 + 1)).otherwise(F.col("source"))
    return p.table(spark, sf, "documents").select("doc_id", t.is_uuid(x).alias("valid"), t.date_or_text(day).alias("day"))


@query("p13_question_status", """SELECT m.meeting_id, CASE WHEN m.meeting_id % 6 = 0 THEN 'empty_question' WHEN s.meeting_id IS NULL THEN 'not_found' WHEN s.n = 0 THEN 'empty_transcript' ELSE 'ok' END AS status
FROM (SELECT meeting_id FROM meetings UNION SELECT meeting_id FROM notes) m LEFT JOIN (SELECT meeting_id, count_if(trim(text) <> '') AS n FROM segments GROUP BY meeting_id) s USING (meeting_id)""", "meetings", "notes")
def _(spark, sf):
    asked = p.meetings(spark, sf).select("meeting_id").union(p.notes(spark, sf).select("meeting_id")).distinct()
    asked = asked.withColumn("question", F.when(F.col("meeting_id") % 6 == 0, " ").otherwise("Why?"))
    return catalog.question_status(asked, p.meetings(spark, sf), p.segments(spark, sf))


@query("d09_template_faults", r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'template name cannot be empty' WHEN doc_id % 9 = 1 THEN 'template prompt cannot be empty' WHEN strlen(n) > 200 THEN 'template name exceeds 200 characters'
  WHEN strlen(q) > 10000 THEN 'template prompt exceeds 10000 characters' END AS fault FROM (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 5 = 0 THEN text ELSE source END, '^\s+|\s+$', '', 'g') AS n, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q FROM documents)""")
def _(spark, sf):
    name = F.when(F.col("doc_id") % 4 == 0, "  ").when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.col("source"))
    return p.table(spark, sf, "documents").select("doc_id", dml.template_fault(name, F.when(F.col("doc_id") % 9 != 1, F.col("text"))).alias("fault"))


@query("v08_model_picks", """SELECT event_id, CASE WHEN ram <= 5 THEN 'asr-base' WHEN ram <= 9 THEN 'asr-large-v3-turbo-q5' WHEN ram >= 24 OR apple OR (ram >= 16 AND cores >= 12) THEN 'asr-large-v3-turbo' ELSE 'asr-large-v3-turbo-q5' END AS asr,
  CASE WHEN ram <= 5 THEN NULL WHEN ram <= 15 THEN 'llm-qwen3-4b' WHEN ram <= 23 THEN 'llm-qwen3-8b' ELSE 'llm-qwen3-14b' END AS llm, CASE WHEN ram BETWEEN 16 AND 23 AND NOT apple AND cores >= 12 THEN 'medium' ELSE 'high' END AS confidence,
  ram <= 9 OR (ram <= 23 AND NOT apple AND free < 3) AS warned FROM (SELECT event_id, event_id % 40 AS ram, event_id % 3 = 0 AS apple, event_id % 17 AS cores, event_id % 5 AS free FROM events)""")
def _(spark, sf):
    i = F.col("event_id")
    h = p.table(spark, sf, "events").select("event_id", *picks.model_picks(i % 40, i % 3 == 0, i % 17, i % 5))
    return h.select("event_id", "asr", "llm", "confidence", "warned")


# --- streams in batch form ----------------------------------------------------------------------

CHUNK, RATE = 7, 1000


def frames(spark, sf) -> DataFrame:
    """Events as frames of one to five samples of their level; sessions in three that stay open."""
    w = Window.partitionBy("session_id").orderBy("seq")
    edge = F.when(F.col("type").isin("paused", "resumed"), F.col("type") == "paused")
    e = p.session_events(spark, sf).withColumn("paused", F.coalesce(F.last(edge, True).over(w), F.lit(False)))
    ended = (F.col("seq") == F.max("seq").over(Window.partitionBy("session_id"))) & (F.col("session_id") % 3 != 0)
    samples = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 5).cast("int")), lambda i: (F.col("rms") + i / 100.0).cast("float"))
    return e.select(F.col("session_id").cast("string").alias("session_id"), "seq", samples.alias("samples"), "paused", ended.alias("ended"))


@query("st01_chunks", f"""WITH x AS (SELECT *, coalesce(lag(paused) OVER (PARTITION BY session_id ORDER BY seq), false) AS was FROM frames),
e AS (SELECT *, sum(CASE WHEN paused <> was THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS epoch FROM x),
s AS (SELECT session_id, epoch, (rms + i / 100.0)::FLOAT AS y, row_number() OVER (PARTITION BY session_id, epoch ORDER BY seq, i) - 1 AS pos, max(ended) OVER (PARTITION BY session_id, epoch) AS closed FROM e, range(0, 5) r(i) WHERE i < n),
g AS (SELECT session_id, epoch, pos // {CHUNK} AS k, count(*) AS n, sqrt(avg(y::DOUBLE * y)) AS level, round(sum(y::DOUBLE), 4) AS total, bool_or(closed) AS closed FROM s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY epoch, k) - 1 AS i FROM g WHERE n = {CHUNK} OR closed)
SELECT session_id::VARCHAR AS session_id, i AS chunk_index, i * {CHUNK} AS offset_ms, CASE WHEN n = {CHUNK} THEN {CHUNK} ELSE n END AS duration_ms, CASE WHEN level < 0.03 THEN 'skipped' ELSE 'chunk' END AS type, CASE WHEN level >= 0.03 THEN total END AS total FROM o""", "session_events", "frames")
def _(spark, sf):
    c = chunks.chunked(frames(spark, sf), CHUNK, RATE, silence=0.03).filter("type IN ('chunk', 'skipped')")
    total = F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4)
    return c.select("session_id", "chunk_index", "offset_ms", "duration_ms", "type", total.alias("total"))


@query("st04_pause_events", """SELECT session_id::VARCHAR AS session_id, type, count(*) AS n FROM (
  SELECT session_id, CASE WHEN paused THEN 'paused' ELSE 'resumed' END AS type, paused, coalesce(lag(paused) OVER (PARTITION BY session_id ORDER BY seq), false) AS was FROM frames) WHERE paused <> was GROUP BY ALL
UNION ALL SELECT session_id::VARCHAR, 'stopped', count(*) FROM frames WHERE ended GROUP BY ALL""", "session_events", "frames")
def _(spark, sf):
    c = chunks.chunked(frames(spark, sf), CHUNK, RATE).filter("type IN ('paused', 'resumed', 'stopped')")
    return c.groupBy("session_id", "type").agg(F.count("*").alias("n"))


def recording_events(spark, sf) -> DataFrame:
    """Events as those of recordings: most sessions have a start, a third of them a stop, and another third a failure."""
    e = p.session_events(spark, sf).select("*", F.col("session_id").cast("string").alias("sid"))
    seg = lambda i: F.struct(F.concat_ws("-", "event_id", F.lit(str(i))).alias("id"), (F.col("seq") * 100 + i * 50).alias("start_ms"), (F.col("seq") * 100 + i * 50 + 40).alias("end_ms"), F.lit("x").alias("text"), F.lit("s1").alias("speaker_id"), F.lit(1.0).cast("float").alias("confidence"))
    body = e.filter("type IS NOT NULL").select(
        "type", F.col("sid").alias("session_id"), (F.col("seq") + 1).alias("seq"), (F.col("seq") * 100).alias("offset_ms"), "duration_ms",
        F.when(F.col("event_id") % 3 == 0, "es").when(F.col("event_id") % 3 == 1, "en").alias("language"), F.concat(F.lit("s"), F.col("event_id") % 2).alias("speaker_id"), (F.col("event_id") % 2).cast("int").alias("speaker_slot"),
        F.when(F.col("event_id") % 4 != 0, F.array(seg(0), seg(1))).otherwise(F.slice(F.array(seg(0)), 1, 0)).alias("segments"),
        F.lit(None).cast("long").alias("total_segments"), F.lit(None).cast("long").alias("total_audio_ms"), F.lit(None).cast("string").alias("message"), F.timestamp_seconds(F.lit(1704067200) + F.col("seq")).alias("at"),
    )
    ids = e.groupBy("sid", "session_id").agg(F.max("seq").alias("seq"))
    names = body.columns
    start = ids.filter("session_id % 7 <> 0").select(F.lit("started").alias("type"), F.col("sid").alias("session_id"), F.lit(0).cast("long").alias("seq"), F.lit("Talk").alias("message"), F.timestamp_seconds(F.lit(1704067200)).alias("at"))
    stop = ids.filter("session_id % 3 <> 0").select(
        F.when(F.col("session_id") % 3 == 1, "stopped").otherwise("failed").alias("type"), F.col("sid").alias("session_id"), (F.col("seq") + 2).alias("seq"), F.lit(9).cast("long").alias("total_segments"), F.lit(99999).cast("long").alias("total_audio_ms"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("seq")).alias("at"),
    )
    return body.unionByName(start, allowMissingColumns=True).unionByName(stop, allowMissingColumns=True).select(*names)


@query("st12_recordings", """WITH e AS (SELECT *, (seq + 1) AS s2, CASE WHEN event_id % 4 <> 0 THEN 2 ELSE 0 END AS segs FROM session_events WHERE type IS NOT NULL AND session_id % 7 <> 0),
f AS (SELECT *, CASE WHEN type = 'skipped' THEN duration_ms ELSE 0 END AS skip FROM e),
w AS (SELECT *, coalesce(sum(skip) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM f),
t AS (SELECT session_id, sum(CASE WHEN type = 'chunk' THEN segs ELSE 0 END)::BIGINT AS segs, greatest(coalesce(max(CASE WHEN type = 'chunk' THEN CASE WHEN segs > 0 THEN seq * 100 + 90 ELSE 0 END + later END), 0), sum(skip))::BIGINT AS fallback FROM w GROUP BY session_id),
v AS (SELECT session_id, CASE event_id % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'en' END AS language, count(*) AS n FROM e WHERE type = 'chunk' AND event_id % 3 <> 2 GROUP BY ALL),
l AS (SELECT session_id, language FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, language) AS rn FROM v) WHERE rn = 1)
SELECT i.session_id::VARCHAR AS id, i.session_id % 3 <> 0 AS over, CASE i.session_id % 3 WHEN 1 THEN 99999 WHEN 2 THEN coalesce(t.fallback, 0) ELSE 0 END::BIGINT AS duration_ms,
  CASE WHEN i.session_id % 3 <> 0 THEN l.language END AS language, CASE WHEN i.session_id % 3 = 1 THEN 9 ELSE coalesce(t.segs, 0) END::BIGINT AS segment_count
FROM (SELECT DISTINCT session_id FROM session_events WHERE session_id % 7 <> 0) i LEFT JOIN t USING (session_id) LEFT JOIN l USING (session_id)""", "session_events")
def _(spark, sf):
    m = recorder.recorded(recording_events(spark, sf))["meetings"]
    return m.select("id", F.col("ended_at").isNotNull().alias("over"), "duration_ms", "language", "segment_count")


@query("st12_recorded_parts", """WITH e AS (SELECT * FROM session_events WHERE type = 'chunk' AND session_id % 7 <> 0)
SELECT session_id::VARCHAR AS meeting_id, 'segments' AS relation, sum(CASE WHEN event_id % 4 <> 0 THEN 2 ELSE 0 END)::BIGINT AS n FROM e GROUP BY session_id HAVING sum(CASE WHEN event_id % 4 <> 0 THEN 2 ELSE 0 END) > 0
UNION ALL SELECT session_id::VARCHAR, 'speakers', count(DISTINCT event_id % 2) FROM e GROUP BY session_id""", "session_events")
def _(spark, sf):
    r = recorder.recorded(recording_events(spark, sf))
    counts = [r[x].groupBy("meeting_id").agg(F.count("*").alias("n")).select("meeting_id", F.lit(x).alias("relation"), "n") for x in ("segments", "speakers")]
    return counts[0].unionByName(counts[1])


@query("a06_session_counters", """SELECT session_id::VARCHAR AS session_id, count_if(type = 'chunk') AS chunks, count_if(type = 'skipped') AS skipped, sum(CASE WHEN type = 'chunk' AND event_id % 4 <> 0 THEN 90 ELSE 0 END)::BIGINT AS audio_ms
FROM session_events WHERE session_id % 7 <> 0 GROUP BY session_id""", "session_events")
def _(spark, sf):
    e = recorder.accepted(recording_events(spark, sf))
    return recorder.session_totals(e).select("session_id", "chunks", "skipped", "audio_ms")


@query("st06_voiced_chunks", _recursive(_automaton("rms * 10", *sessions.NEURAL) + "SELECT session_id AS session, seq // 16 AS chunk, bool_or(voiced) AS voiced FROM r WHERE seq >= 0 GROUP BY ALL"))
def _(spark, sf):
    """Levels as probabilities of a neural detector, 16 frames a chunk; a chunk is voiced if one of its frames is."""
    e = p.session_events(spark, sf).withColumn("probability", F.col("rms") * 10)
    voiced = sessions.hysteresis(e, "session_id", "seq", "probability", *sessions.NEURAL)
    return voiced.groupBy("session", F.floor(F.col("seq") / 16).alias("chunk")).agg(F.bool_or("voiced").alias("voiced"))


def _tokens(spark, sf) -> DataFrame:
    """Words of turns as a model's tokens; every second answer starts with a thought, whose marks are cut in two:
    what comes before a mark is whole has been shown by then."""
    c = p.table(spark, sf, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("reply_id"), "text")
    text = F.when(F.col("reply_id") % 2 == 0, F.concat(F.lit("<thi\x00nk>hm </th\x00ink>"), "text")).otherwise(F.col("text"))
    return c.select("reply_id", F.posexplode(F.split(F.regexp_replace(text, " ", " \x00"), "\x00")).alias("seq", "token")).select("reply_id", F.col("seq").cast("long").alias("seq"), "token")


@query("st17_shown_tokens", """SELECT conv_id * 100000 + turn AS reply_id, md5(CASE WHEN turn % 2 = 0 THEN '<thi' || ltrim(text) ELSE text END) AS shown FROM conversations""")
def _(spark, sf):
    return replies.answer_text(replies.shown(_tokens(spark, sf))).select("reply_id", F.md5("text").alias("shown"))


@query("st18_answer_events", """WITH c AS (SELECT conv_id * 100000 + turn AS reply_id, text, len(string_split(text, ' ')) AS n FROM conversations)
SELECT reply_id, 0::BIGINT AS event, 'started' AS type, md5('m1') AS text, NULL AS cited FROM c
UNION ALL SELECT reply_id, i, 'token', md5(string_split(text, ' ')[i] || CASE WHEN i < n THEN ' ' ELSE '' END), NULL FROM c, generate_series(1, n) g(i)
UNION ALL SELECT reply_id, n + 1, CASE WHEN reply_id % 5 = 0 THEN 'failed' ELSE 'finished' END, md5(CASE WHEN reply_id % 5 = 0 THEN 'broken' ELSE text END), CASE WHEN reply_id % 5 <> 0 THEN '' END FROM c""")
def _(spark, sf):
    c = p.table(spark, sf, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("reply_id"), "text")
    words = F.split(F.regexp_replace("text", " ", " \x00"), "\x00")
    tokens = c.select("reply_id", F.posexplode(words).alias("seq", "delta")).withColumn("seq", F.col("seq").cast("long"))
    asked = c.select("reply_id", F.lit("m1").alias("model"), F.when(F.col("reply_id") % 5 == 0, "broken").alias("error"), F.array(F.lit("1")).alias("ids"))
    out = replies.answer_events(asked, tokens)
    return out.select("reply_id", "event", "type", F.md5("text").alias("text"), F.array_join("citations", ",").alias("cited"))
