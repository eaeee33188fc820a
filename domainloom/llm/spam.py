"""Keyword-stuffed and link-list pages by robust outlier distance, per language, in spam-directed directions.

Each text gives five numbers: link density, word entropy, local repetition,
function-word share, and the share of words in lines that are no sentences.  For
every language the centre and scatter of these are estimated robustly over all of
its texts (median and MAD, then concentration steps on the closer half).  A text
is flagged when its Mahalanobis distance is an outlier's and its deviation points
towards spam: more links, repetition and loose words, less entropy and fewer
function words, together rather than one of them.  Tables, code, headings or
repeated prose deviate far too, but in other directions.  What is flagged must
then hold more than half of its words in loose lines or such that one word
dominates.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Function words that mark sentences, by language; those of other languages are learned from their texts.
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it with as was on by which be are from at this but not an or had has were been have its than when while because so they who no if only both one more there between we our into how whether would once per after although however then still did does these such most several what where your you nobody",
    "de": "der die das und ist ein eine den im von zu mit für auf nicht des dem sich wir zum zur als bei nach oft wenn haben hat kein wird werden weshalb um sind nur dass häufig zwischen einem eines einer durch aus",
    "fr": "le la les des et est une un du en pour dans que qui sur par nous sont ce reste lorsque plus au aux de avons sans très ont après avec ne pas",
    "es": "el los las y es una del por para con se no lo al su entre cuando muy que más un puede otra como pero sin sobre",
}
FEATURES = ["links", "entropy", "repetition", "function", "loose"]
#: Direction of spam in each feature.
TOWARDS = np.array([1.0, -1.0, 1.0, -1.0, 1.0])
#: Least scale of each feature, so that one that hardly varies does not outweigh the others.
FLOOR = np.array([0.1, 0.05, 0.05, 0.05, 0.05])
CUTOFF = 12.83  # 0.975 quantile of chi-square with 5 degrees of freedom
#: Least cosine between a deviation and the spam direction, both in units of the scatter.  One feature alone reaches 0.45, two equal ones 0.63.
DIRECTION = 0.6
#: Of normal data, the scatter of the closer half times this is the scatter of all (5 dimensions).
CONSISTENCY = 1.92
#: Words of the centre that a text's own numbers are averaged with, and texts of all languages that a language's are.
PRIOR_WORDS, PRIOR_TEXTS = 8.0, 50.0
#: Content words within which a word counts as repeated.
WINDOW = 30
#: Function words that make a line a sentence: a tenth of its words; more of them where at least half of the other words are repeated
#: (and yet more where no sentence ends), and where every tenth word is a link.
LEAST_FUNCTION, FUNCTION_OF_REPEATED, FUNCTION_WITHOUT_END, FUNCTION_BESIDE_LINKS = 0.1, 0.2, 0.4, 0.25
#: A line is dominated by a word that has three places and this share of it.
DOMINATING = 1 / 6

#: Share and number of different short words from which they are taken for the function words of an unknown language.
SHORT_SHARE, SHORT_KINDS = 0.15, 8

_OPEN = re.compile(r"(?i)<a\s")
_HREF = re.compile(r"(?i)href\s*=\s*[\"']?([^\"'>\s]*)")
_CLOSE = re.compile(r"(?i)</a\s*>")
_BREAK = re.compile(r"(?i)</?(?:br|p|div|li|tr|h[1-6]|ul|ol|table)\b[^<>]*>")
_TAG = re.compile(r"<[^<>\n]+>")
_HIDDEN = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e]")
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhABEKMHOPCTXIJS")
_DASH = re.compile("[\u2010\u2011\u2012\u2212]")
_CYRILLIC, _LATIN = re.compile("[\u0400-\u052f]"), re.compile("[a-zA-Z]")
_MIXED = re.compile(r"\w*(?:[a-zA-Z][\u0400-\u052f]|[\u0400-\u052f][a-zA-Z])\w*")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_JOINING = str.maketrans("", "", "-'’/")
_LEET_SIGNS = frozenset("013457@$")
#: A link by its scheme, or a host name of letters, digits and dots with an ending of letters, with or without a path.
_LINK = re.compile(r"(?i)^(?:h(?:tt|xx)ps?://|www\.)\S|^[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,24}(?:[:/?#]\S*)?$")
_CODE = re.compile(r"\s[-+]?==?\s|\w\((?!s\))|\)[:;.]|\w\[|^\s*(?:return|def|class)\s")
_RESIDUES = re.compile(r"^[A-Z*\-]{12,}$")
_END = re.compile(r"(?:[^\W\d_]|\w\w\w)[.!?…][\"'”»)]*(?:\s|$)")
_HAN = re.compile(r"[぀-ヿ㐀-鿿]")
_KANA = re.compile(r"[぀-ヿ]")
_EDGE = ".,;:!?()[]{}\"'“”„«»…-–—*|/>»•·¿¡#"


def _anchors(text: str) -> str:
    """``[label](link)`` for every anchor, of any length and with markup in its label; of one that is not closed, ``(link)``.

    Each place is searched a fixed number of times, so long texts of open tags take linear time.
    """
    out, at, closing, more = [], 0, None, True
    opening = _OPEN.search(text)
    while opening:
        end = text.find(">", opening.end())
        if end < 0:
            break
        following = _OPEN.search(text, end)
        if href := _HREF.search(text, opening.end() - 1, end):
            if more and (closing is None or closing.start() < end):
                closing = _CLOSE.search(text, end)
                more = closing is not None
            out.append(text[at : opening.start()])
            if more and not (following and following.start() < closing.start()):
                out.append(f"[{_TAG.sub(' ', text[end + 1 : closing.start()])}]({href[1]})")
                at = closing.end()
            else:
                out.append(f"({href[1]}) ")
                at = end + 1
        opening = following
    return "".join(out) + text[at:]


def plain(text: str) -> str:
    """The text as a reader sees it: entities and markup resolved, hidden characters gone, look-alike letters in Latin."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _BREAK.sub("\n", _anchors(text)))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
        if _CYRILLIC.search(text):
            # letters of both scripts in one word are a disguise; words of one script are left alone
            text = _MIXED.sub(lambda m: m[0].translate(_LOOKALIKE), text)
        text = _DASH.sub("-", text)
    return text.replace("\r", "\n").replace("](", "] (")


def line_words(line: str, lexicon: dict[str, tuple[str, ...]]) -> tuple[list[str], int, int]:
    """Lower-case words without edge punctuation, the number of links, and that of all parts; numbers, units, identifiers and sequences are only parts.

    Digits and signs that stand for letters are read as these where a word remains.
    """
    words, links, after_number = [], 0, False
    tokens = line.split()
    for token, x in zip(tokens, line.lower().split()):
        if not x.isalpha():
            x = x.strip(_EDGE)
            if not x:
                continue
            if not x.isalpha():
                after_number = x[-1].isdigit()
                if "." in x or "/" in x:
                    # a bare host name looks like an attribute, which is what it is on a line of code
                    if _LINK.match(x.replace("[.]", ".")) and ("/" in x or x[:4] == "www." or not _CODE.search(line)):
                        links += 1
                        continue
                if not _LEET_SIGNS.isdisjoint(x) and _LATIN.search(x):
                    x = x.translate(_LEET)
                if x.translate(_JOINING).isalpha() and not (len(x) >= 12 and _RESIDUES.match(token)):
                    words.append(x)
                continue
        if after_number:
            after_number = False
            if len(x) <= 3 and x not in lexicon:
                continue
        if len(x) < 12 or not _RESIDUES.match(token.strip(_EDGE)):
            words.append(x)
    return words, links, len(tokens)


def assess(text: str | None, lexicon: dict[str, tuple[str, ...]]) -> tuple[str, int, float, list[float]]:
    """``(language, words, share of its parts in loose or dominated lines, features)`` of a whole text; language ``none`` where no language shows three different function words.

    ``lexicon`` gives the languages of each function word.  In a text that shows
    fewer than one in twenty of these but many different words of up to three
    letters, those stand in for them, as in most languages of letters.  Sentences of Chinese and Japanese
    count by their characters.
    """
    whole = plain(text or "")
    parsed, shown, known, counted, han_total, all_parts = [], Counter(), 0, 0, 0, 0
    for line in whole.split("\n"):
        if not line or line.isspace():
            continue
        han = 0 if line.isascii() else len(_HAN.findall(line))
        words, links, parts = line_words(line, lexicon)
        if han > 6 and han > 2 * len(words):
            # about two characters a word
            han_total += han
            words = [w for w in words if not _HAN.search(w)]
        else:
            han = 0
        rest = [w for w in words if w not in lexicon]
        if len(rest) < len(words):
            shown.update([w for w in words if w in lexicon])
        known += len(words) - len(rest)
        counted += len(words)
        all_parts += parts + han // 2
        if words or links or han:
            parsed.append((words, rest, links, han, parts, line))
    short = False
    if known < counted / 20:
        brief = [w for words, *_ in parsed for w in words if len(w) <= 3]
        short = len(brief) >= SHORT_SHARE * counted and len(set(brief)) >= SHORT_KINDS
    n = in_links = function = loose = loose_parts = near = content = place = 0
    seen: Counter = Counter()
    last: dict[str, int] = {}
    for words, rest, links, han, parts, line in parsed:
        k = len(words)
        if short:
            rest = [w for w in rest if len(w) > 3]
        f = k - len(rest)
        # a word can only have three places where at least two are repeats
        most = max(Counter(rest).values()) if len(set(rest)) < len(rest) - 1 else 0
        before = near
        for w in rest:
            place += 1
            if place - last.get(w, -WINDOW) <= WINDOW:
                near += 1
            last[w] = place
        repeats = 2 * (near - before) >= len(rest)
        if f < LEAST_FUNCTION * k or not k:
            is_loose = not (f and not repeats and _END.search(line))
        elif 10 * links >= k:
            is_loose = f < FUNCTION_BESIDE_LINKS * k
        else:
            is_loose = repeats and f < FUNCTION_WITHOUT_END * k and (f < FUNCTION_OF_REPEATED * k or not _END.search(line))
        n += k + links + han // 2
        function += f + han // 4
        in_links += links
        if is_loose and not links and _CODE.search(line):
            is_loose = False  # code is no sentence and no list of words either
        if not han and (is_loose or most >= 3 and most >= DOMINATING * k):
            loose += k + links
            loose_parts += parts
            if is_loose and links:
                in_links += k  # what stands beside links outside sentences labels them
        seen.update(rest)
        content += len(rest)
    if not n:
        return "none", 0, 0.0, [0.0, 1.0, 0.0, 0.0, 0.0]
    entropy = 1.0
    if content >= 2:
        p = np.fromiter(seen.values(), dtype=float, count=len(seen)) / content
        entropy = float(-(p * np.log(p)).sum() / math.log(content))
    if han_total > n / 2:
        lang = "ja" if _KANA.search(whole) else "zh"
    else:
        hits, kinds = Counter(), Counter()
        for w, times in shown.items():
            for name in lexicon[w]:
                hits[name] += times
                kinds[name] += 1
        lang = max((name for name in hits if kinds[name] >= 3), key=lambda name: (hits[name], name), default="none")
    return lang, n, loose_parts / all_parts, [in_links / n, entropy, near / content if content else 0.0, function / n, loose / n]


def function_words(documents: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> dict[str, tuple[str, ...]]:
    """The languages of each function word: the fixed lists, and what texts of other languages (by their label) use most.

    Learned are words of at most four letters that a tenth of a language's texts
    hold, by the lower end of the count's uncertainty; so few texts teach little.
    Only counts per language and word are collected, at most some dozens for each
    language that the labels name.
    """
    out: dict[str, list[str]] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in words.split():
            out.setdefault(w, []).append(lang)
    if lang_col is not None and lang_col in documents.columns:
        lang = F.lower(F.substring(F.trim(F.col(lang_col)), 1, 2))
        rows = documents.select(lang.alias("lang"), F.col(text_col).alias("text")).where(~F.col("lang").isin(*FUNCTION_WORDS) & F.col("text").isNotNull())
        short = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}])([\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsArabic}\p{IsHebrew}]{1,4})(?![\p{L}\p{N}])"), F.lit(1)))
        counts = rows.select("lang", F.explode(F.concat(short, F.array(F.lit(""))))).groupBy("lang", F.col("col").alias("word")).agg(F.count(F.lit(1)).alias("n"))
        all_texts = counts.where("word = ''").select("lang", F.col("n").alias("texts"))
        frequent = counts.where("word <> ''").join(F.broadcast(all_texts), "lang").where(F.col("n") - 2 * F.sqrt("n") >= 0.1 * F.col("texts"))
        for r in frequent.collect():
            out.setdefault(r["word"], []).append(r["lang"])
    return {w: tuple(sorted(set(langs))) for w, langs in out.items()}


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``id_col, language, words, share`` and the features of every text; only these two columns are read."""
    kind = documents.schema[id_col].dataType.simpleString()
    lexicon = lexicon or function_words(documents, text_col, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [assess(t, lexicon) for t in pdf["_text"]]
            out = pd.DataFrame({"_id": pdf["_id"].array, "language": [r[0] for r in rows], "words": [r[1] for r in rows], "share": [r[2] for r in rows]})
            for k, name in enumerate(FEATURES):
                out[name] = [r[3][k] for r in rows]
            yield out

    numbers = ", ".join(f"{name} double" for name in FEATURES)
    # the id goes through Python as text, so that integers of any size and nulls stay what they are
    made = documents.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, f"_id string, language string, words bigint, share double, {numbers}")
    return made.select(F.col("_id").cast(kind).alias(id_col), "language", "words", "share", *FEATURES)


def _scored(rows: DataFrame, model: dict[str, tuple[np.ndarray, np.ndarray]], shrink: bool) -> DataFrame:
    """``rows`` with ``distance`` (squared Mahalanobis) and ``towards`` (component of the deviation in the spam direction, in units of the scatter).

    With ``shrink``, a text's deviation is that of its words beside ``PRIOR_WORDS`` words of the centre.
    """
    table = []
    for lang, (centre, scatter) in model.items():
        inverse = np.linalg.inv(scatter)
        along = np.sqrt(np.diag(scatter)) * TOWARDS
        table.append((lang, centre.tolist(), inverse.ravel().tolist(), (inverse @ along / math.sqrt(along @ inverse @ along)).tolist()))
    # one row per language, and one for all of them
    spark = rows.sparkSession
    models = F.broadcast(spark.createDataFrame(table, "_lang string, _c array<double>, _p array<double>, _g array<double>"))
    named = F.when(F.col("language").isin([lang for lang in model]), F.col("language")).otherwise("*")
    weight = F.col("words") / (F.col("words") + PRIOR_WORDS) if shrink else F.lit(1.0)
    k = range(len(FEATURES))
    away = rows.withColumn("_lang", named).join(models, "_lang").withColumns({f"_x{i}": (F.col(FEATURES[i]) - F.get("_c", F.lit(i))) * weight for i in k})
    total = lambda terms: sum(terms[1:], terms[0])
    distance = total([F.col(f"_x{i}") * F.col(f"_x{j}") * F.get("_p", F.lit(i * len(FEATURES) + j)) for i in k for j in k])
    towards = total([F.col(f"_x{i}") * F.get("_g", F.lit(i)) for i in k])
    return away.withColumns({"distance": distance, "towards": towards}).drop("_lang", "_c", "_p", "_g", *[f"_x{i}" for i in k])


def robust_models(rows: DataFrame, steps: int = 3) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and scatter per language, and of all texts under ``*``.

    Starts at medians and MADs; each concentration step takes the closer half of
    a group's texts and estimates from them, scaled to be consistent.  Counts and
    sums cover all texts that have words.  A language's estimate is averaged with
    that of all texts, which weighs as much as ``PRIOR_TEXTS`` of its own.  What
    reaches the driver is one row per language of the lexicon.
    """
    grouped = rows.where(F.col("words") > 0).withColumn("language", F.explode(F.when(F.col("language") == "none", F.array(F.lit("*"))).otherwise(F.array("language", F.lit("*")))))
    medians = grouped.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, 0.5, 1000).alias(c) for c in FEATURES]).collect()
    if not medians:
        return {}
    texts = {r["language"]: r["n"] for r in medians}
    centres = {r["language"]: np.array([r[c] for c in FEATURES]) for r in medians}

    def averaged(model: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        share = {lang: n / (n + PRIOR_TEXTS) if lang != "*" else 1.0 for lang, n in texts.items()}
        return {lang: tuple(share[lang] * own + (1 - share[lang]) * pooled for own, pooled in zip(model[lang], model["*"])) for lang in model}

    middle = F.create_map(*[x for lang, m in centres.items() for x in (F.lit(lang), F.array(*[F.lit(float(v)) for v in m]))])
    away = grouped.withColumn("_m", F.element_at(middle, F.col("language")))
    mads = away.groupBy("language").agg(*[F.percentile_approx(F.abs(F.col(c) - F.get("_m", F.lit(k))), 0.5, 1000).alias(c) for k, c in enumerate(FEATURES)]).collect()
    model = averaged({r["language"]: (centres[r["language"]], np.diag(np.maximum(1.4826 * np.array([r[c] for c in FEATURES]), FLOOR) ** 2)) for r in mads})
    products = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    for _ in range(steps):
        at = _scored(grouped, model, False)
        half = {r["language"]: r["h"] for r in at.groupBy("language").agg(F.percentile_approx("distance", 0.5, 1000).alias("h")).collect()}
        limit = F.element_at(F.create_map(*[x for lang, h in half.items() for x in (F.lit(lang), F.lit(float(h)))]), F.col("language"))
        sums = at.where(F.col("distance") <= limit).groupBy("language").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in FEATURES],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in products],
        ).collect()
        estimate = dict(model)
        for r in sums:
            mean = np.array([r[c] for c in FEATURES]) / r["n"]
            scatter = np.empty((len(FEATURES), len(FEATURES)))
            for i, j in products:
                scatter[i, j] = scatter[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
            estimate[r["language"]] = mean, scatter * CONSISTENCY + np.diag(FLOOR**2)
        model = averaged(estimate)
    return model


def assessed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``id_col, language, words, distance, towards, cosine, candidate, share, spam`` of every text.

    ``candidate`` are outliers by ``distance`` that lie towards spam by ``cosine``;
    ``spam`` those with more than half of what they hold (words, links, numbers) in
    loose or dominated lines with words or links.
    Null, empty and blank texts have no words and are no spam.  Texts of no known
    language are measured against all texts.  Equal texts get equal results;
    ``lang_col`` (may be absent) only helps to learn function words, other columns
    are ignored.
    """
    rows = stage(features(documents, id_col, text_col, function_words(documents, text_col, lang_col)))
    model = robust_models(rows)
    if not model:
        # no text has words
        model = {"*": (np.array([0.0, 1.0, 0.0, 0.4, 0.0]), np.diag(FLOOR**2))}
    cosine = F.coalesce(F.col("towards") / F.nullif(F.sqrt("distance"), F.lit(0.0)), F.lit(0.0))
    candidate = (F.col("words") > 0) & (F.col("distance") > CUTOFF) & (F.col("cosine") >= DIRECTION)
    return _scored(rows, model, True).withColumn("cosine", cosine).select(
        id_col, "language", "words", "distance", "towards", "cosine", candidate.alias("candidate"), "share", (candidate & (F.col("share") > 0.5)).alias("spam"),
    )
