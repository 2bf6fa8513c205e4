"""Text scalars as column expressions, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of other tools for equal results.
CONTROL_TOKENS = ("<|im_start|>", "<|im_end|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "</s>")
INTERROGATIVES = ("who", "what", "when", "where", "why", "how", "which", "whose", "whom")
AUXILIARIES = (
    "is", "are", "was", "were", "am", "do", "does", "did", "can", "could", "would", "should", "will", "shall", "have", "has", "had", "may", "might",
    "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "can't", "couldn't", "wouldn't", "shouldn't", "won't",
)
SPANISH_QUESTIONS = (
    "quién", "quiénes", "qué", "cuándo", "dónde", "cómo", "cuál", "cuáles", "cuánto", "cuánta", "cuántos", "cuántas",
    "quien", "quienes", "que", "cuando", "donde", "como", "cual", "cuales", "cuanto", "cuanta", "cuantos", "cuantas",
)
SPANISH_PREPOSITIONS = ("por", "en", "de", "a", "para", "desde", "hasta", "con")
SPANISH_AFTER = ("qué", "que", "quién", "quien", "quiénes", "quienes")
HALLUCINATIONS = (
    "gracias por ver el video", "gracias por ver este video", "muchas gracias por ver el video", "no olviden suscribirse", "suscribete al canal",
    "suscribanse al canal", "nos vemos en el proximo video", "subtitulos por la comunidad de amara.org", "subtitulos realizados por la comunidad de amara.org",
    "subtitulado por la comunidad de amara.org", "subtitulos en espanol", "mas informacion www.alimmenta.com", "no speech", "blank audio", "silence",
    "silencio", "music", "musica", "thanks for watching", "thank you for watching", "subscribe to the channel", "subtitles by the amara.org community",
)
# Letters whose full capital is several characters (SS), by the capital that is one; others of the kind have none and stay.
ONE_CAPITAL = {"ß": "ẞ", "ᾳ": "ᾼ", "ῃ": "ῌ", "ῳ": "ῼ"} | {chr(i + j): chr(i + j + 8) for i in (0x1F80, 0x1F90, 0x1FA0) for j in range(8)}
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
TRUNCATED = "\n[… (transcript truncated for length) …]\n"
LABEL_CHARS = 80


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def speaker_name(label: Column, slot: Column) -> Column:
    """The label if it isn't blank, else its place."""
    return F.when(trimmed(label) != "", label).otherwise(F.concat(F.lit("Speaker "), (slot + 1).cast("string")))


def normal_label(label: Column) -> tuple[Column, Column]:
    """The label to store (blank is null), and whether it's short enough."""
    t = trimmed(label)
    return F.nullif(t, F.lit("")), F.coalesce(F.char_length(t) <= LABEL_CHARS, F.lit(True))


def short_tag(slot: Column) -> Column:
    return F.concat(F.lit("S"), (slot + 1).cast("string"))


def palette(slot: Column, size: int = 8) -> Column:
    return F.pmod(slot, F.lit(size))


def without_control_tokens(x: Column) -> Column:
    """Each token is removed once over the whole text, in this order."""
    for token in CONTROL_TOKENS:
        x = F.replace(x, F.lit(token), F.lit(""))
    return x


def is_question(text: Column, language: Column) -> Column:
    words = F.split(trimmed(F.lower(text)), "(?U)\\s+")
    first, second = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    spanish = first.isin(*SPANISH_QUESTIONS) | (first.isin(*SPANISH_PREPOSITIONS) & second.isin(*SPANISH_AFTER))
    english = first.isin(*INTERROGATIVES, *AUXILIARIES)
    return text.startswith("¿") | F.when(F.coalesce(language, F.lit("en")).startswith("es"), spanish).otherwise(english)


def capital_letter(letter: Column) -> Column:
    """The capital of one letter, as one letter."""
    one = F.translate(letter, "".join(ONE_CAPITAL), "".join(ONE_CAPITAL.values()))
    return F.when(F.char_length(F.upper(letter)) > 1, one).otherwise(F.upper(letter))


def punctuated(text: Column, language: Column) -> Column:
    """A capital letter and a closing mark, unless there is one."""
    t = trimmed(text)
    capital = F.concat(capital_letter(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))
    closed = F.substring(t, -1, 1).isin(".", "!", "?", "…", ":", ";")
    return F.when(t == "", "").when(closed, capital).otherwise(F.concat(capital, F.when(is_question(t, language), "?").otherwise(".")))


def is_hallucination(text: Column) -> Column:
    """A marker in brackets, or one of the phrases that speech models make of silence."""
    t = trimmed(text)
    wrapped = (t.startswith("[") & t.endswith("]")) | (t.startswith("(") & t.endswith(")"))
    plain = F.lower(F.regexp_replace(t, "^[\\p{Punct}¡¿…]+|[\\p{Punct}¡¿…]+$", ""))
    plain = trimmed(F.regexp_replace(F.translate(plain, "áéíóú_", "aeiou "), "(?U)\\s+", " "))
    return (t != "") & (wrapped | plain.isin(*HALLUCINATIONS))


def is_loop(text: Column) -> Column:
    """One to three words, four times or more in a row."""
    single = F.regexp_replace(trimmed(text), "(?U)\\s+", " ")
    return single.rlike("(?:^| )([^ ]+(?: [^ ]+){0,2})(?: \\1){3}(?: |$)")


def wer_words(text: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes."""
    words = F.split(F.lower(text), "(?U)\\s+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^\\p{L}\\p{N}']", "")), lambda w: w != "")


def citations(text: Column) -> Column:
    """Segment ids cited as [seg:ID], each once, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("\\[seg:([^\\]]*)\\]"), F.lit(1)))


def minutes_seconds(ms: Column, padded: bool = True) -> Column:
    """Minutes and seconds; minutes never become hours."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d" if padded else "%d:%02d", F.floor(s / 60), s % 60)


def spoken_length(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), s % 60))


def head_and_tail(text: Column, most: int = 6000, head: int = 4000, tail: int = 2000) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit(TRUNCATED), F.right(text, F.lit(tail)))).otherwise(text)


def without_thoughts(text: Column) -> Column:
    """Without <think> blocks; one that isn't closed takes the rest."""
    return F.regexp_replace(F.regexp_replace(text, "(?s)<think>.*?(</think>|\\z)", ""), "(?U)^\\s+", "")


def cut_at_stop(text: Column, stops: tuple[str, ...]) -> Column:
    """The text before the earliest stop sequence."""
    at = [F.nullif(F.locate(s, text), F.lit(0)) for s in stops]
    first = at[0] if len(at) == 1 else F.least(*at)
    return F.when(first.isNotNull(), F.substring(text, F.lit(1), first - 1)).otherwise(text)


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def language_instruction(language: Column) -> Column:
    """What a prompt says about the answer's language; its texts are fixed values."""
    code = F.lower(F.coalesce(language, F.lit("")))
    other = F.concat(F.lit("Always respond in the same language as the meeting transcript (ISO code: "), code, F.lit(")."))
    return F.when(code.isin("es", "es-mx", "es-es", "es-419"), "Responde SIEMPRE en español neutro.").when(code.isin("", "en", "en-us", "en-gb"), "Always respond in English.").otherwise(other)


def duration(start_ms: Column, end_ms: Column) -> Column:
    return F.greatest(end_ms - start_ms, F.lit(0))


def samples_of(ms: Column, rate: Column, channels: Column) -> Column:
    return F.floor(rate * ms / 1000) * channels


def frames_of(samples: Column, channels: Column) -> Column:
    """Frames of interleaved samples; none without channels."""
    return F.when(channels > 0, F.floor(samples / channels)).otherwise(0).cast("long")


def ms_of(samples: Column, rate: Column, channels: Column) -> Column:
    frames = F.when(channels > 0, F.floor(samples / channels)).otherwise(0)
    return F.when(rate > 0, F.floor(frames * 1000 / rate)).otherwise(0)


def real_time_factor(elapsed: Column, audio: Column) -> Column:
    return F.when(audio > 0, elapsed / audio).otherwise(0.0)


def is_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike(UUID), F.lit(False))


def title_from(template: Column, started_ms: Column) -> Column:
    return F.replace(template, F.lit("{date}"), F.date_format(F.timestamp_millis(started_ms), "yyyy-MM-dd"))


def date_or_text(x: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """A readable date; what isn't one stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(x), fmt), x)
