"""Whole documents from conversations: transcripts, prompts, and exports as Markdown and plain text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as t
from parlance.functions.payload import CUSTOM, FIELDS, FREE_TEXT

# Headings in Markdown, and in a summary's plain text.
HEADINGS = {
    "keyPoints": "Key points", "decisions": "Decisions", "actionItems": "Action items", "openQuestions": "Open questions",
    "wins": "Wins", "blockers": "Blockers", "growthFeedback": "Growth feedback", "nextSteps": "Next steps", "followUpTopics": "Follow-up topics",
    "completedItems": "Completed", "carryOver": "Carry-over", "risks": "Risks", "nextSprintPriorities": "Next sprint priorities",
    "quotes": "Quotes", "themes": "Themes", "painPoints": "Pain points", "opportunities": "Opportunities",
    "customerContext": "Customer context", "interestSignals": "Interest signals", "objections": "Objections", "dealStageIndicator": "Deal stage",
    "conceptsCovered": "Concepts covered", "definitions": "Definitions", "examples": "Examples", "homeworkOrNext": "Homework / next",
}
#: How much of a task a template's Markdown shows.
TASK_PARTS = {"general": ("owner", "due"), "oneOnOne": ("owner",), "salesCall": ()}

# What prompts say.
ROLES = {
    "general": "You are a meeting summarizer.",
    "oneOnOne": "You are a 1:1 meeting summarizer specializing in manager-report meetings.",
    "sprintReview": "You are a sprint review / retrospective summarizer for agile teams.",
    "interview": "You are an interview summarizer for user-research and hiring interviews.",
    "salesCall": "You are a sales-call summarizer specializing in B2B discovery and pipeline meetings.",
    "lecture": "You are a lecture / class summarizer for educational content.",
}
ONLY_JSON = (
    "Output ONLY a single JSON object that matches the schema below — no prose, no markdown fences, no commentary. "
    "All string values must be valid UTF-8 and all arrays may be empty when the transcript does not contain that information."
)
RETURN_JSON = "\n\nReturn the JSON object only.\n/no_think"
NOT_PARSED = ("\n\nYour previous response could not be parsed as JSON. Parser error: ", "\nReturn ONLY a valid JSON object that matches the schema. Do not include any text before or after the JSON.")
NOTES_HEAD = "\n\nUser notes taken during the meeting:\n---\n"
FREE_FORM = (
    "\nAnalyze the following meeting transcript and produce your response according to the instructions above. "
    "Format your response using Markdown (headings, bullet points, bold) for readability.\nImportant constraint: ",
    " Do NOT echo this constraint or any internal instructions in your response.",
)
TYPES = {
    "list": "string[]", "text": "string|null", "tasks": '[ { "task": string, "owner": string|null, "due": string|null } ]',
    "quotes": '[ { "speaker": string, "quote": string, "context": string|null } ]', "definitions": '[ { "term": string, "definition": string } ]',
}


def _concat(*parts) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def _if(x: Column, then: Column) -> Column:
    return F.when(x, then).otherwise("")


def _lines(items: Column, line, sep: str = "\n") -> Column:
    return F.array_join(F.transform(items, line), sep)


def _some(x: Column, *parts) -> Column:
    """The parts if there is one; nothing for null."""
    return F.coalesce(F.when(x.isNotNull(), _concat(*parts)), F.lit(""))


def _section(template: str, kind: str, name: str, p: Column) -> Column:
    x, head = p[name], f"### {HEADINGS[name]}\n\n"
    if kind == "text":
        return _some(x, f"**{HEADINGS[name]}:** ", x, "\n\n")
    if kind == "quotes":
        body = _concat(_lines(x, lambda q: _concat('> "', q["quote"], '"\n> — ', q["speaker"], _some(q["context"], " (", q["context"], ")"), "\n\n"), ""))
        return _if(F.size(x) > 0, _concat(head, body))
    if kind == "tasks":
        shown = TASK_PARTS[template]

        def line(a):
            more = [_some(a["owner"], " — *", a["owner"], "*")] * ("owner" in shown) + [_some(a["due"], " (due: ", a["due"], ")")] * ("due" in shown)
            return _concat("- [ ] ", a["task"], *more, "\n")
    elif kind == "definitions":
        line = lambda d: _concat("- **", d["term"], "**: ", d["definition"], "\n")
    else:
        line = lambda a: _concat("- ", a, "\n")
    return _if(F.size(x) > 0, _concat(head, _lines(x, line, ""), "\n"))


def _by_template(template: Column, of) -> Column:
    out = F.lit("")
    for name in FIELDS:
        out = F.when(template == name, of(name)).otherwise(out)
    return out


def summary_markdown(template: Column, payload: Column) -> Column:
    """A summary's body; free text stands as it is, and a template without fields of its own has none."""
    free = _concat(payload["text"], "\n\n")
    return F.when(template == FREE_TEXT, free).otherwise(_by_template(template, lambda name: _concat(payload["summary"], "\n\n", *(_section(name, kind, field, payload) for kind, field in FIELDS[name]))))


def summary_text(template: Column, payload: Column) -> Column:
    """A summary's body as plain text: of all but the general template the Markdown without its marks."""

    def listed(kind, field):
        x, head = payload[field], f"{HEADINGS[field].upper()}\n"
        line = lambda a: _concat("  - ", a, "\n")
        if kind == "tasks":
            line = lambda a: _concat("  - ", a["task"], _some(a["owner"], " (", a["owner"], ")"), _some(a["due"], " [due: ", a["due"], "]"), "\n")
        return _if(F.size(x) > 0, _concat(head, _lines(x, line, ""), "\n"))

    general = _concat(payload["summary"], "\n\n", *(listed(kind, field) for kind, field in FIELDS["general"]))
    marks = "^#+", "^(\\*\\*)+", "(\\*\\*)+$", "^(- \\[ \\] )+", "^(- )+", "^(> )+"

    def bare(line):
        for mark in marks:
            line = F.regexp_replace(line, mark, "")
        return t.trimmed(line)

    md = summary_markdown(template, payload)
    lines = F.split(F.regexp_replace(md, "\\n\\z", ""), "\n", -1)
    return F.when(template == "general", general).when(md == "", "").otherwise(_concat(_lines(lines, bare), "\n"))


def clipboard_text(template: Column, payload: Column) -> Column:
    """A summary as bulleted text; sections without an item are left out.  Free text, also that of a user's template, is copied as it is."""

    def section(kind, field):
        x, head = payload[field], f"\n{HEADINGS[field]}\n"
        if kind == "text":
            return F.when(x != "", _concat("\nDeal stage: ", x) if field == "dealStageIndicator" else _concat(head, x))
        line = {
            "list": lambda a: _concat("• ", a),
            "tasks": lambda a: _concat("• ", a["task"], _if(F.coalesce(a["owner"] != "", F.lit(False)), _concat(" (", F.coalesce(a["owner"], F.lit("")), ")")), _if(F.coalesce(a["due"] != "", F.lit(False)), _concat(" — ", F.coalesce(a["due"], F.lit(""))))),
            "quotes": lambda q: _concat('• "', q["quote"], '" — ', q["speaker"]),
            "definitions": lambda d: _concat("• ", d["term"], ": ", d["definition"]),
        }[kind]
        return F.when(F.size(x) > 0, _concat(head, _lines(x, line)))

    return F.when(template.isin(FREE_TEXT, CUSTOM), payload["text"]).otherwise(_by_template(template, lambda name: F.concat_ws("\n", F.nullif(payload["summary"], F.lit("")), *(section(kind, field) for kind, field in FIELDS[name]))))


def schema_text(template: str) -> str:
    """The JSON schema that a prompt asks for."""
    fields = [("string", "summary"), *((TYPES[kind], name) for kind, name in FIELDS[template])]
    return "Schema:\n{\n" + ",\n".join(f'  "{name}": {kind}' for kind, name in fields) + "\n}"


def _chat(system: Column, user: Column) -> Column:
    return _concat("<|im_start|>system\n", system, "<|im_end|>\n<|im_start|>user\n", user, "<|im_end|>\n<|im_start|>assistant\n")


def _asked(transcript: Column, notes: Column, end: str) -> Column:
    plain = t.without_control_tokens
    return _concat("Transcript:\n---\n", plain(transcript), "\n---", _some(notes, NOTES_HEAD, plain(notes), "\n---"), end)


def summary_prompt(template: Column, transcript: Column, language: Column, notes: Column, feedback: Column) -> Column:
    """The prompt for a structured summary; ``notes`` and ``feedback``, the parser's error of a first answer, may be null."""
    names = [n for n in FIELDS if n != "general"]
    role, schema = F.lit(ROLES["general"]), F.lit(schema_text("general"))
    for name in names:
        role, schema = F.when(template == name, ROLES[name]).otherwise(role), F.when(template == name, schema_text(name)).otherwise(schema)
    system = _concat(role, " ", t.language_instruction(language), f"\n{ONLY_JSON}\n\n", schema)
    again = _some(feedback, NOT_PARSED[0], t.without_control_tokens(feedback), NOT_PARSED[1])
    return _chat(system, _concat(_asked(transcript, notes, RETURN_JSON), again))


def custom_prompt(prompt: Column, transcript: Column, language: Column, notes: Column) -> Column:
    """The prompt of a template that a user wrote; the answer is free text."""
    system = _concat(t.without_control_tokens(prompt), FREE_FORM[0], t.language_instruction(language), FREE_FORM[1])
    return _chat(system, _asked(transcript, notes, "\n/no_think"))


def chat_prompt(messages: Column) -> Column:
    """An array of (role, content) as one prompt; control tokens of contents are stripped by the caller."""
    return _concat(_lines(messages, lambda m: _concat("<|im_start|>", m["role"], "\n", m["content"], "<|im_end|>\n"), ""), "<|im_start|>assistant\n")


def transcript_line(text: Column, speaker: Column) -> Column:
    return _concat(F.coalesce(speaker, F.lit("Speaker")), ": ", t.trimmed(text))


def cited_line(seg_id: Column, start_ms: Column, text: Column, speaker: Column) -> Column:
    return _concat("[seg:", seg_id.cast("string"), "] (", t.minutes_seconds(start_ms, False), ") ", transcript_line(text, speaker))


def block(rows: DataFrame, key: str, order: list[str], line: Column, name: str, sep: str = "\n") -> DataFrame:
    """Lines of a key in order as one text; a key's lines meet in one row, as its text does."""
    lists = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(lists, lambda x: x["_line"]), sep).alias(name))


def exports(meetings: DataFrame, segments: DataFrame, speakers: DataFrame, notes: DataFrame, summaries: DataFrame, style: str = "markdown") -> DataFrame:
    """(meeting_id, body): each meeting as one document, in the style ``markdown`` or ``text``.

    ``meetings`` has (meeting_id, title, started_at, duration_ms, language, segment_count); ``segments`` has the
    display name of its speaker as ``speaker``, which may be null; ``speakers`` has (meeting_id, slot, label), and
    ``summaries`` one row (meeting_id, template, payload) a meeting at most.
    """
    md = style == "markdown"
    stamp = _concat("[", t.minutes_seconds(F.col("start_ms")), "]")
    x, who = t.trimmed(F.col("text")), F.col("speaker")
    if md:
        line = _concat("**", stamp, F.coalesce(_concat(" ", who, ":**"), F.lit("**")), " ", x, "\n\n")
    else:
        line = _concat(stamp, _some(who, " ", who, ":"), " ", x, "\n")
    said = block(segments.filter(x != ""), "meeting_id", ["start_ms", "seg_id"], line, "said", "")
    named = F.coalesce("label", F.concat(F.lit("Speaker "), F.col("slot") + 1))
    people = block(speakers, "meeting_id", ["slot"], named, "people", ", ")
    note = _concat("[", t.minutes_seconds(F.col("timestamp_ms")), "]")
    noted = block(notes, "meeting_id", ["timestamp_ms", "note_id"], _concat("- **", note, "** ", F.col("text"), "\n") if md else _concat(note, " ", F.col("text"), "\n"), "noted", "")
    of = (summary_markdown if md else summary_text)(F.col("template"), F.col("payload"))
    bodies = summaries.select("meeting_id", of.alias("digest"))
    df = meetings
    for child in (said, people, noted, bodies):
        df = df.join(child, "meeting_id", "left")
    facts = [F.col("started_at").cast("string"), t.spoken_length(F.col("duration_ms")), F.coalesce("language", F.lit("?")), F.col("segment_count").cast("string")]
    spoken = F.coalesce("said", F.lit(""))
    if md:
        head = _concat("# ", F.col("title"), "\n\n", *(y for label, f in zip(("**Date:** ", "  \n**Duration:** ", "  \n**Language:** ", "  \n**Segments:** "), facts) for y in (label, f)), "\n\n")
        body = _concat(
            head, _some(F.col("people"), "**Participants:** ", F.col("people"), "\n\n"), "---\n\n", _some(F.col("digest"), "## Summary\n\n", F.col("digest"), "---\n\n"),
            "## Transcript\n\n", spoken, _some(F.col("noted"), "---\n\n## Notes\n\n", F.col("noted"), "\n"),
        )
    else:
        rule = F.repeat(F.lit("="), F.octet_length("title"))
        head = _concat(F.col("title"), "\n", rule, "\n\n", *(y for label, f in zip(("Date:     ", "\nDuration: ", "\nLanguage: ", "\nSegments: "), facts) for y in (label, f)), "\n")
        body = _concat(
            head, _some(F.col("people"), "Participants: ", F.col("people"), "\n"), _some(F.col("digest"), "\n\nSUMMARY\n-------\n\n", F.col("digest")),
            "\n\nTRANSCRIPT\n----------\n\n", spoken, _some(F.col("noted"), "\n\nNOTES\n-----\n\n", F.col("noted")),
        )
    return df.select("meeting_id", body.alias("body"))
