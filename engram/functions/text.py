"""Text columns: tokens, language, similarity, hashes and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of keyword search, by language.
STOP_EN = (
    "the an is are was were be been being have has had do does did will would shall should can could may might must am me my we our "
    "you your he him his she her it its they them their this that these those what which who whom whose when where why how all each "
    "every both few more most other some such no not only same so than too very just but and or if then for of to in on at by with "
    "from up about into through during before after above below between out off over under again further once here there any as "
    "because until while also still already even now re ll ve"
).split()
STOP_RU = (
    "и в на с по не что это как а то все он она мы вы они но за от до из у при для о об так же ни ну бы да нет его её их мне мой мои "
    "моя моё наш ваш свой кто где когда уже ещё тоже также быть был была было были будет есть нас вас себя там тут сам вот этот тот который"
).split()
STOP_ZH = (
    "的 了 在 是 我 有 和 就 不 人 都 一 个 上 也 很 到 说 要 去 你 会 着 没有 看 好 来 对 他 她 它 这 那 些 们 把 被 让 给 用 与 及 等 "
    "可以 已经 因为 所以 但是 如果 虽然 或者 而且 以及 还是 就是"
).split()
TOKEN = "[a-zA-ZА-Яа-яёЁ0-9]+"
#: (pattern, days), the first match wins.
# Time phrases and the days that they look back.
TEMPORAL = (
    (r"(?i)\b(?:today|yesterday|last\s*(?:24\s*h|night))\b", 1),
    (r"(?i)(?:^|\s)(?:сегодня|вчера|за\s*(?:последние\s*)?сутки)(?:\s|$)", 1),
    (r"(?i)\b(?:(?:this|last|past)\s*week|last\s*(?:7|seven)\s*days)\b", 7),
    (r"(?i)(?:^|\s)(?:(?:на\s*)?(?:этой|прошлой)\s*неделе|за\s*(?:последн(?:юю|ие)\s*)?неделю|последни[ех]\s*7\s*дн)", 7),
    (r"(?i)\b(?:(?:this|last|past)\s*month|last\s*(?:30|thirty)\s*days)\b", 30),
    (r"(?i)(?:^|\s)(?:(?:в\s*)?(?:этом|прошлом)\s*месяце|за\s*(?:последний\s*)?месяц|последни[ех]\s*30\s*дн)", 30),
    (r"(?i)\b(?:(?:this|last|past)\s*(?:quarter|3\s*months)|last\s*(?:90|ninety)\s*days)\b", 90),
    (r"(?i)(?:^|\s)(?:за\s*(?:последни[ехй]\s*)?(?:3\s*месяц|квартал))", 90),
    (r"(?i)\b(?:recently|recent)\b", 30),
    (r"(?i)(?:^|\s)(?:недавно|последн(?:ее|ие|ий))(?:\s|$)", 30),
)


def search_language(text: Column) -> Column:
    """'ru' above 20 % Cyrillic, 'zh' above 30 % CJK, else 'en', of characters that are no space or punctuation."""
    bare = F.regexp_replace(text, r"[\s\p{P}]", "")
    total = F.length(bare)
    cyrillic = total - F.length(F.regexp_replace(bare, r"[Ѐ-ӿ]", ""))
    cjk = total - F.length(F.regexp_replace(bare, r"[一-鿿㐀-䶿]", ""))
    return F.when(cyrillic > 0.20 * total, "ru").when(cjk > 0.30 * total, "zh").otherwise("en")


def chat_language(text: Column) -> Column:
    """'zh' above 30 % CJK, then 'ru' above 30 % Cyrillic, of letters and digits."""
    bare = F.regexp_replace(text, r"[^\p{L}\p{N}]", "")
    total = F.length(bare)
    cjk = total - F.length(F.regexp_replace(bare, r"[一-鿿㐀-䶿]", ""))
    cyrillic = total - F.length(F.regexp_replace(bare, r"[Ѐ-ӿ]", ""))
    return F.when(cjk > 0.3 * total, "zh").when(cyrillic > 0.3 * total, "ru").otherwise("en")


def lexemes(text: Column) -> Column:
    """Lower-cased word tokens, all of them, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def keywords(text: Column) -> Column:
    """Search tokens: lexemes without single characters, numbers and the language's stop words."""

    def chosen(s: Column) -> Column:
        lang = s["lang"]
        return F.filter(
            s["words"],
            lambda t: (F.length(t) > 1)
            & ~t.rlike("^[0-9]+$")
            & ~((lang == "en") & t.isin(*STOP_EN))
            & ~((lang == "ru") & t.isin(*STOP_RU))
            & ~((lang == "zh") & t.isin(*STOP_ZH)),
        )

    # a one-element array binds the language and the words, so neither is computed again for every word
    bound = F.array(F.struct(search_language(text).alias("lang"), lexemes(text).alias("words")))
    return F.get(F.transform(bound, chosen), F.lit(0))


def or_query(tokens: Column) -> Column:
    return F.array_join(tokens, " | ")


def text_rank(tokens: Column, query: Column) -> Column:
    """Matched term frequency, damped by length: tf / (1 + ln(1 + tokens))."""
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(query, t)))
    return hits / (1 + F.log1p(F.size(tokens)))


def content_hash(text: Column) -> Column:
    """First 16 bytes (32 hex digits) of the SHA-256 of the trimmed lower-case text."""
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, 32)


def temporal_days(query: Column) -> Column:
    """Days that the query's time phrase looks back; 0 without one."""
    out = F.lit(0)
    for pattern, days in reversed(TEMPORAL):
        out = F.when(query.rlike(pattern), days).otherwise(out)
    return out


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the distinct characters; 0 if a text is empty."""
    x, y = F.array_distinct(_chars(a)), F.array_distinct(_chars(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def _bigrams(text: Column) -> Column:
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))
    return F.array_distinct(many)


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of character 2-grams; 0 if a text is empty."""
    x, y = _bigrams(a), _bigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((a == "") | (b == ""), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def char_tfidf(a: Column, b: Column) -> Column:
    """Cosine of character counts; a character of one text only weighs 1.5."""
    x, y = _chars(a), _chars(b)

    def total(of: Column, f) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda s, c: s + f(c))

    def count(of: Column, c: Column) -> Column:
        return F.size(F.filter(of, lambda d: d == c)).cast("double")

    dx, dy = F.array_distinct(x), F.array_distinct(y)
    top = total(F.array_intersect(dx, dy), lambda c: count(x, c) * count(y, c))
    weight = lambda other, c: F.when(F.array_contains(other, c), 1.0).otherwise(2.25)
    nx = total(dx, lambda c: count(x, c) * count(x, c) * weight(dy, c))
    ny = total(dy, lambda c: count(y, c) * count(y, c) * weight(dx, c))
    return F.when((a == "") | (b == ""), 0.0).otherwise(top / (F.sqrt(nx) * F.sqrt(ny)))


def text_similarity(a: Column, b: Column) -> Column:
    """0.40 Dice + 0.35 character TF-IDF + 0.25 bigram Jaccard; near duplicates reach 0.92."""
    return 0.40 * dice(a, b) + 0.35 * char_tfidf(a, b) + 0.25 * bigram_jaccard(a, b)


def strip_fence(text: Column) -> Column:
    """JSON without its Markdown code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def strip_think(text: Column) -> Column:
    """Text outside <think>...</think>; an unclosed one runs to the end."""
    return F.regexp_replace(text, r"(?s)<think>.*?(</think>|\z)", "")


def think_parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)<think>(.*?)(?:</think>|\z)"), F.lit(1))


def canary_bucket(user: Column) -> Column:
    """The first four bytes of SHA-256 as an unsigned number, modulo 100."""
    return F.conv(F.substring(F.sha2(user, 256), 1, 8), 16, 10).cast("long") % 100


def answer_normalize(text: Column) -> Column:
    """Evaluation form: lower case, without articles and punctuation, single spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\b(a|an|the)\b", " ")
    t = F.regexp_replace(t, r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(answer_normalize(text), " "), lambda t: t != "")
