"""Scalar functions on names, addresses, subjects, file names and texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mail conventions that these functions follow.
NAME_SUFFIXES = ["jr", "i", "ii", "iii", "iv", "v"]
SECOND_LEVEL_DOMAINS = ["ac", "co"]
PUBLIC_PROVIDERS = ["hotmail", "gmail", "yahoo", "live", "msn", "pacbell", "vsnl", "comcast", "rediffmail"]
LIST_MARKS = ["@yahoogroups", "@googlegroups", "@lists.", "@mailman", "no-reply", "do-not-reply"]
#: Longest list mark in front of a subject, brackets included, is one less.
LIST_NAME_LENGTH = 20
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp"]
DOCUMENT_EXTENSIONS = ["doc", "docx", "pages", "ppt", "pptx", "key", "xls", "xlsx", "numbers", "pdf"]
# Scripts (as Unicode block names of Java's patterns) and the languages that they stand for.
SCRIPT_LANGUAGES = {
    "Armenian": "armenian", "Hebrew": "hebrew", "Arabic": "arabic", "Devanagari": "hindi,marathi", "Bengali": "bengali", "Gurmukhi": "punjabi",
    "Gujarati": "gujarati", "Oriya": "oriya", "Tamil": "tamil", "Telugu": "telugu", "Kannada": "kannada", "Malayalam": "malayalam", "Thai": "thai",
    "Georgian": "georgian", "Greek_Extended": "greek", "CJK_Unified_Ideographs": "chinese", "Hiragana": "japanese", "Katakana": "japanese", "Hangul_Syllables": "korean",
}


def words(text: Column, pattern: str = r"\s+") -> Column:
    """Tokens between delimiters, without empty ones."""
    return F.filter(F.split(text, pattern), lambda w: w != "")


def clean_email(address: Column) -> Column:
    """Lower-cased, without quotes and blanks at both ends."""
    return F.lower(F.regexp_replace(address, r"""^['"\s]+|['"\s]+$""", ""))


def user_of(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def org_of(address: Column) -> Column:
    """The second-level domain (one deeper below ac and co); null for public providers and what is no address."""
    parts = words(address, "[@. !]+")
    second = F.lower(F.try_element_at(parts, F.lit(-2)))
    org = F.when(second.isin(SECOND_LEVEL_DOMAINS), F.try_element_at(parts, F.lit(-3))).otherwise(second)
    return F.when(address.contains("@") & (F.size(parts) >= 3) & ~org.isin(PUBLIC_PROVIDERS), org)


def last_name(name: Column) -> Column:
    """The last word that is no generational suffix, if there are two such words at least and it has two characters."""
    real = F.filter(words(name), lambda w: ~F.lower(w).isin(NAME_SUFFIXES))
    last = F.try_element_at(real, F.lit(-1))
    return F.when((F.size(real) >= 2) & (F.length(last) >= 2), last)


def clean_person_name(name: Column, banned_words: list[str] | None = None) -> Column:
    """A display name without quotes, bracketed remarks and surplus blanks; null for junk and for single words."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), r"^'(.*)'$", "$1"), r'^"(.*)"$', "$1")
    body = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\([^)]*\)", ""), r"\[[^\]]*\]", ""))
    parts = words(body)
    good = bare.rlike(r"\p{L}") & (F.size(parts) >= 2)
    if banned_words:
        good = good & ~F.exists(parts, lambda w: F.lower(w).isin(banned_words))
    return F.when(name.contains("@"), F.lower(F.trim(name))).when(good, F.array_join(parts, " "))


def lookup_name(name: Column) -> Column:
    """The order-free form of a name: lower-cased words in order of the alphabet, without dots, commas and initials."""
    cleaned = clean_person_name(name)
    parts = F.transform(words(F.regexp_replace(cleaned, "[.,]", " ")), F.lower)
    long = F.filter(parts, lambda w: F.length(w) > 1)
    kept = F.when((F.size(parts) > 2) & (F.size(long) >= 2), long).otherwise(parts)
    single = F.regexp_replace(F.lower(name), r"^\W+|\W+$", "")
    return F.when(cleaned.isNotNull(), F.array_join(F.array_sort(kept), " ")).when(~name.contains(" "), single)


def names_from_email(address: Column) -> Column:
    """Possible names in the local part: 2 or 3 words between dots or underscores, none of digits only, capitalised."""
    local = F.regexp_replace(user_of(address), "%.*$", "")

    def by(mark: str) -> Column:
        parts = words(local, mark)
        fits = F.size(parts).between(2, 3) & ~F.exists(parts, lambda w: w.rlike("^[0-9]+$"))
        capital = F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
        return F.when(fits, F.array_join(capital, " "))

    return F.array_compact(F.array(by("[.]"), by("_")))


def is_list_address(address: Column) -> Column:
    """Whether an address looks like a mailing list or an unattended sender."""
    return F.greatest(*[F.lower(address).contains(m) for m in LIST_MARKS])


def clean_subject(subject: Column) -> Column:
    """Without leading reply, forward and [list] marks; words parted and followed by single blanks."""
    marks = rf"(?i)^(?:(?:re:?|\[?fwd:?|\[\S{{0,{LIST_NAME_LENGTH - 3}}}\])\s+)+(?=\S)"
    body = F.regexp_replace(F.trim(F.regexp_replace(subject, r"\s+", " ")), marks, "")
    return F.concat(body, F.lit(" "))


def normalized_subject(subject: Column) -> Column:
    """Lower-cased, without one leading `re ` or `re: `."""
    return F.regexp_replace(F.lower(subject), r"^re:? (?=[\s\S])", "")


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines; each line trimmed and ended by a newline."""
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")
    return F.transform(blocks, lambda p: F.concat(F.array_join(F.transform(words(p, "\n"), lambda x: F.trim(x)), "\n"), F.lit("\n")))


def original_content(text: Column) -> Column:
    """The part that the sender wrote: up to a forward or reply separator, quoted lines replaced by a stop mark."""
    lines = F.split(normalize_newlines(text), "\n")

    def stops(line: Column, i: Column) -> Column:
        t, after = F.trim(line), F.trim(F.get(lines, i + 1))
        rule = t.rlike("^_{21,}$") & (F.instr(F.get(lines, i + 1), ":") > 1)
        wrote = t.startswith("On ") & (t.endswith("wrote:") | ((F.length(t) < 80) & F.coalesce(after.endswith("wrote:"), F.lit(False))))
        begun = F.lower(t).startswith("begin forwarded message:")
        dashed = t.startswith("---") & t.endswith("---") & F.lower(t).rlike("forwarded message|original message")
        return F.coalesce(rule, F.lit(False)) | wrote | begun | dashed

    ends = F.array_position(F.transform(lines, stops), F.lit(True))
    kept = F.when(ends > 0, F.slice(lines, F.lit(1), (ends - 1).cast("int"))).otherwise(lines)
    body = F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"^\s*>.*$", " . ")), "\n")
    return F.when(ends > 1, F.concat(body, F.lit("\n"))).otherwise(body)


def extension(filename: Column, longest: int | None = None) -> Column:
    """What follows the last dot, lower-cased, if the dot is not the first character; null if there is none."""
    found = F.lower(F.regexp_extract(filename, r"^.+\.([^.]*)$", 1))
    has = filename.rlike(r"^.+\.[^.]*$")
    return F.when(has & (F.length(found) <= longest), found) if longest else F.when(has, found)


def url_domain(url: Column) -> Column:
    """The last two labels of the host, without protocol and leading www, lower-cased."""
    host = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://", ""), r"[/?:#].*$", "")
    labels = words(F.regexp_replace(host, r"^www[^.]*\.", ""), "[.]")
    return F.when(F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(F.array_join(labels, "."))


def url_tail(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]*)$", 1)


def links_in(text: Column) -> Column:
    """Web links of a text, without trailing punctuation."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"""(https?:[^\s<>"']+)"""), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", ""))


def hrefs(html: Column) -> Column:
    """Targets of the links of a page, as written."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def scripts_languages(text: Column) -> Column:
    """Languages by the scripts in a text; english is always one."""
    found = [F.when(text.rlike(rf"\p{{In{block}}}"), F.split(F.lit(langs), ",")) for block, langs in SCRIPT_LANGUAGES.items()]
    return F.array_distinct(F.concat(F.flatten(F.array_compact(F.array(*found))), F.array(F.lit("english"))))


def acronyms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{3,})\b"), F.lit(1)))


def acronym_of(phrase: Column) -> Column:
    return F.array_join(F.transform(F.filter(words(phrase), lambda w: w.rlike("^[A-Z]")), lambda w: F.substring(w, 1, 1)), "")


def ellipsized(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def canonical_term(term: Column) -> Column:
    """A lower-cased word without one of the common endings; the word itself if less than two characters would stay."""
    stem = F.regexp_replace(F.lower(term), "(?:ment|ing|ed|ly|s)$", "")
    return F.when(F.length(stem) >= 2, stem).otherwise(F.lower(term))


def canonical_entity(name: Column) -> Column:
    """The words of an entity, lower-cased and in order of the alphabet."""
    return F.array_join(F.array_sort(words(F.lower(name), r"[\s,.;:\-]+")), " ")


def word_runs(text: Column) -> Column:
    """All runs of neighbouring words."""
    w = words(text)
    n = F.size(w)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(w, i, k), " "))))


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?<!\p{{L}})\Q{word}\E(?!\p{{L}})")


def masked_email(address: Column, key: str) -> Column:
    """The address with its domain replaced by a short digest, equal for equal domains."""
    return F.concat(user_of(address), F.lit("@"), F.substring(F.sha2(F.concat(F.lit(key), F.substring_index(address, "@", -1)), 256), 1, 8))


def redacted(text: Column, names: Column) -> Column:
    """A text in which only words of the given names stay; the letters of all others become dots."""
    own = F.flatten(F.transform(names, lambda n: words(F.lower(n), "[^a-z0-9]+")))
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z0-9]") & ~F.array_contains(own, F.lower(r)), F.repeat(F.lit("."), F.length(r))).otherwise(r)), "")


def signature(*parts: Column) -> Column:
    """SHA-256 of the parts of a message that identify it."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def array_text(values: Column, mark: str = "|") -> Column:
    """An array of texts as one text."""
    return F.array_join(values, mark)


def cleaned_message(text: Column) -> Column:
    """A message up to its signature (a line of two dashes) or a forward or reply mark."""
    return F.regexp_replace(text, r"(?s)(?:^|\n)(?:-- ?\n|-{2,} ?(?:Original|Forwarded) Message|[^\n]*wrote:\s*\n).*$", "")


def escaped_html(text: Column) -> Column:
    out = text
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescaped_html(text: Column) -> Column:
    out = text
    for raw, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def blanked_word(text: Column, word: str) -> Column:
    """The text with a word replaced by underscores of equal length; words of one letter stay."""
    return text if len(word) < 2 else F.regexp_replace(text, rf"(?i)(?<!\p{{L}})\Q{word}\E(?!\p{{L}})", "_" * len(word))


def longest_word(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(words(text), lambda w: F.length(w))), F.lit(0))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def without_titles(name: Column) -> Column:
    return F.regexp_replace(name, r"^(?i)(?:(?:mr|mrs|ms|dr|prof|sir|madam)\.? )+", "")


def comma_flipped(name: Column) -> Column:
    return F.regexp_replace(name, r"^([^,]+), *([^,]+)$", "$2 $1")


def title_cased(text: Column) -> Column:
    """Each word with a capital first letter, small joining words as they are."""
    small = ["a", "an", "and", "as", "at", "but", "for", "in", "is", "of", "on", "the", "to", "was", "with"]
    return F.array_join(F.transform(words(text), lambda w: F.when(F.lower(w).isin(small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), " ")


def is_acronym_of(short: Column, phrase: Column) -> Column:
    return (short == F.upper(short)) & (acronym_of(phrase) == short) & (F.length(short) > 1)


def sentences(text: Column) -> Column:
    """Sentences by final punctuation before a capital, and by line ends."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=\p{Lu})|\n+"), lambda s: F.trim(s) != "")


def any_term(text: Column, query: str) -> Column:
    """Whether one of the `|`-parted terms is in the text, ignoring case."""
    terms = [t.strip().lower() for t in query.split("|") if t.strip()]
    return F.greatest(*[F.lower(text).contains(t) for t in terms], F.lit(False))
