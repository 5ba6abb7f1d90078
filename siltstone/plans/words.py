"""Queries of broken, run-together and abbreviated words; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import chunks, repair, segments, sentences
from siltstone.plans.registry import docs, query
from siltstone.sources.shared import written

LEXICON = "lx AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) GROUP BY word HAVING count(*) >= 3)"
RARE = "rn AS (SELECT DISTINCT word AS run FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) WHERE word NOT IN (SELECT word FROM lx))"
_FORMS = ["w"] + [f"CASE WHEN w LIKE '%{e}' AND length(w) > {len(e)} THEN {x} END" for e in repair.ENDINGS for s in [f"w[:-{len(e) + 1}]"] for x in [s, f"{s} || 'e'", f"CASE WHEN length({s}) > 2 AND {s}[-1] = {s}[-2] THEN {s}[:-2] END", *([f"CASE WHEN {s} LIKE '%i' THEN {s}[:-2] || 'y' END"] if e in repair.Y_ENDINGS else [])]]
#: Of a table q(w): those that are in the lexicon, themselves (turn 1) or as inflected forms.
KNOWN = "kn AS (SELECT w, min(turn) AS turn FROM (SELECT w, unnest([" + ", ".join(_FORMS) + "]) AS form, generate_subscripts([" + ", ".join("1" if i == 0 else "2" for i in range(len(_FORMS))) + "], 1) AS turn FROM (SELECT DISTINCT w FROM q)) JOIN lx ON form = word GROUP BY w)"


def lexicon(spark, sf_dir):
    return written(chunks.lexicon(docs(spark, sf_dir)), "lexicon")


def _rare_and_known(spark, sf_dir):
    """Runs that are no word of the lexicon, and the lexicon, of one count of all words."""
    counts = written(chunks.lexicon(docs(spark, sf_dir), 1), "words")
    return counts.where("n < 3").select(F.col("word").alias("run")), counts.where("n >= 3")


@query(f"""WITH RECURSIVE {LEXICON}, {RARE},
ar AS (SELECT run, s AS start, s + k AS stop FROM rn, unnest(range(length(run))) a(s), unnest(range(1, least(20, length(run) - s) + 1)) b(k) JOIN lx ON word = substr(run, s + 1, k)),
wy AS (SELECT run, 0::BIGINT AS pos, 0 AS k FROM rn UNION SELECT wy.run, ar.stop, k + 1 FROM wy JOIN ar ON ar.run = wy.run AND ar.start = wy.pos)
SELECT rn.run, CAST(coalesce(min(k), 0) AS BIGINT) AS n_words FROM rn LEFT JOIN wy ON wy.run = rn.run AND pos = length(rn.run) GROUP BY rn.run""")
def word_split_counts(spark, sf_dir):
    """Rare words of the corpus and the fewest frequent ones that make them up, 0 if none do."""
    return segments.best_splits(*_rare_and_known(spark, sf_dir), "words").select("run", F.coalesce("cost", F.lit(0)).cast("long").alias("n_words"))


#: No SQL: the cheapest of all splits; a test holds it against a search of all of them.
@query()
def word_splits(spark, sf_dir):
    """Rare words of the corpus as the likeliest frequent ones."""
    return segments.best_splits(*_rare_and_known(spark, sf_dir)).select("run", F.array_join("pieces", "+").alias("split"), "cost")


def _spoiled(d):
    """Texts with artifacts: the first long word spaced out in capitals before it, ligatures broken, a control character at commas and
    no-break spaces behind full stops."""
    first = F.upper(F.regexp_extract(F.coalesce("text", F.lit("")), "[a-z]{5,}", 0))
    t = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "(fi|ff|fl)([a-z])", "$1 $2"), " th([a-z])", " Th $1")
    t = F.replace(F.replace(t, F.lit(","), F.lit(",\x07")), F.lit(". "), F.lit(".\xa0"))
    return d.select("doc_id", F.concat(F.array_join(F.split(first, ""), " "), F.lit(".\n1-file.indd 12\n"), t).alias("text"))


_SPOILED = r"""sp AS (SELECT doc_id, array_to_string(string_split(upper(regexp_extract(coalesce(text, ''), '[a-z]{5,}')), ''), ' ') || '.' || chr(10) || '1-file.indd 12' || chr(10) ||
replace(replace(regexp_replace(regexp_replace(coalesce(text, ''), '(fi|ff|fl)([a-z])', '\1 \2', 'g'), ' th([a-z])', ' Th \1', 'g'), ',', ',' || chr(7)), '. ', '.' || chr(160)) AS text FROM documents)"""
_COUNT = "len(regexp_extract_all({}, '{}'))"


@query(rf"""WITH {_SPOILED}, p AS (SELECT *, replace(replace(text, chr(7), ''), chr(160), ' ') AS t FROM sp), b AS (SELECT *, regexp_replace(t, '(?i)[^ \t\n\f\r\v]*\.indd\s+[ivxlc\d]+\b', '', 'g') AS u FROM p)
SELECT doc_id, {_COUNT.format('text', '[' + chr(92) + 'x07]')} AS control, {_COUNT.format('text', chr(92) + 'x{A0}')} AS no_break_spaces, {_COUNT.format('t', '(?i)[^ ' + chr(92) + 't' + chr(92) + 'n]*' + chr(92) + '.indd' + chr(92) + 's+[ivxlc' + chr(92) + 'd]+' + chr(92) + 'b')} AS running_heads,
{_COUNT.format('u', chr(92) + 'b(?:[A-Z] ){3,}[A-Z]' + chr(92) + 'b')} AS spaced_capitals, {_COUNT.format('u', chr(92) + 'bTh ([a-z]+)' + chr(92) + 'b')} AS broken_th FROM b""")
def artifact_counts(spark, sf_dir):
    return _spoiled(docs(spark, sf_dir)).select("doc_id", segments.artifacts(F.col("text")).alias("a")).select("doc_id", "a.control", "a.no_break_spaces", "a.running_heads", "a.spaced_capitals", "a.broken_th")


#: No SQL: mending by the corpus' own lexicon; tests hold it against plain texts.
@query()
def alternate_report(spark, sf_dir):
    """Spoiled texts before and after the alternate cleaner."""
    d = written(_spoiled(docs(spark, sf_dir)), "spoiled")
    return segments.report(d, segments.cleaned(d, lexicon(spark, sf_dir)), "doc_id")


def _broken(d, *more):
    """Columns more, and texts whose plain words of eight letters and more have a hyphen and a space behind the fourth."""
    each = lambda w: F.when(w.rlike(r"\A[a-z]{8,}\z"), F.concat(F.left(w, F.lit(4)), F.lit("- "), F.substring(w, F.lit(5), F.char_length(w)))).otherwise(w)
    return d.select("doc_id", *more, F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), " "), each), " ").alias("text"))


@query(rf"""WITH {LEXICON}, tk AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS i FROM documents), q AS (SELECT DISTINCT w FROM tk WHERE regexp_matches(w, '\A[a-z]{{8,}}\z')), {KNOWN},
m AS (SELECT q.w, CASE WHEN kn.w IS NULL OR (f.word IS NOT NULL AND g.word IS NOT NULL) THEN q.w[:4] || '-' || q.w[5:] ELSE q.w END AS made, kn.w IS NOT NULL AND (f.word IS NULL OR g.word IS NULL) AS mended FROM q LEFT JOIN kn ON kn.w = q.w LEFT JOIN lx f ON f.word = q.w[:4] LEFT JOIN lx g ON g.word = q.w[5:])
SELECT doc_id, CAST(count(m.w) AS BIGINT) AS broken, CAST(count(*) FILTER (WHERE mended) AS BIGINT) AS mended, md5(string_agg(coalesce(made, tk.w), ' ' ORDER BY i)) AS digest FROM tk LEFT JOIN m ON m.w = tk.w GROUP BY doc_id""")
def mended_breaks(spark, sf_dir):
    """Words broken by hyphens, mended by the corpus' lexicon."""
    own = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[a-z]-[a-z]")).cast("long").alias("own")
    d = written(_broken(docs(spark, sf_dir), own).withColumn("broken", F.regexp_count("text", F.lit("[a-z]- [a-z]")).cast("long")), "broken")
    out = repair.without_breaks(d, lexicon(spark, sf_dir))
    return out.select("doc_id", "broken", (F.col("broken") - F.regexp_count("text", F.lit("[a-z]-[a-z]")) + F.col("own")).alias("mended"), F.md5("text").alias("digest"))


_NEVER = ", ".join(f"'{w}'" for w in repair.NEVER_FIRST)
_BEFORE = ", ".join(f"'{w}'" for w in repair.PREFIXES)
_BARE = "trim({}, '" + repair.SIGNS.replace("'", "''") + "')"


@query(rf"""WITH {LEXICON}, ln AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), ws AS (SELECT list_filter(regexp_split_to_array(line, '[ \t\r\f\v]+'), lambda x: x <> '') AS w FROM ln),
pr AS (SELECT w[i] AS a, w[i + 1] AS b FROM ws, unnest(range(1, len(w))) t(i)), pc AS (SELECT {_BARE.format('a')} AS f, {_BARE.format('b')} AS s FROM pr),
ok AS (SELECT f, s, count(*) AS n FROM pc WHERE regexp_full_match(f, '\p{{L}}+') AND regexp_full_match(s, '\p{{L}}+') AND lower(f) NOT IN ({_NEVER}) AND NOT (length(f) = 1 AND lower(f) <> f) GROUP BY ALL),
q AS (SELECT lower(f || s) AS w FROM ok UNION SELECT lower(s) FROM ok WHERE lower(f) IN ({_BEFORE})), {KNOWN}
SELECT f AS first, s AS second, n FROM ok WHERE lower(f || s) IN (SELECT w FROM kn) OR (lower(f) IN ({_BEFORE}) AND lower(s) IN (SELECT w FROM kn))""")
def split_word_pairs(spark, sf_dir):
    """Neighbouring words that the corpus' lexicon joins, and how often they stand so."""
    pairs = repair.joinable(docs(spark, sf_dir), lexicon(spark, sf_dir))
    return pairs.select("first", "second", "n")


#: No SQL: passes over what earlier ones joined; a test holds it against a walk over each line.
@query()
def joined_corpus(spark, sf_dir):
    return repair.joined_words(docs(spark, sf_dir).select("doc_id", "text"), lexicon(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"))


_CORE = f"rtrim(ltrim(t, '{sentences.OPENING.replace(chr(39), chr(39) * 2)}'), '{sentences.CLOSING.replace(chr(39), chr(39) * 2)}')"


@query(rf"""WITH tk AS (SELECT unnest(regexp_extract_all(text, '[^\t\n\f\r \x0B\x{{85}}\x{{A0}}]+')) AS t FROM documents), ty AS (SELECT lower(rtrim({_CORE}, '.,;:?!')) AS word, regexp_matches({_CORE}, '[^.]\.$') AS period FROM tk),
al AS (SELECT count(*) AS n, count(*) FILTER (WHERE period) AS p FROM ty WHERE word <> ''), k AS (SELECT word, count(*) FILTER (WHERE period) AS with_period, count(*) FILTER (WHERE NOT period) AS without FROM ty WHERE word <> '' GROUP BY word HAVING count(*) FILTER (WHERE period) > 0 AND regexp_matches(word, '\p{{L}}')),
s AS (SELECT k.*, p / n AS q, length(word) - len(regexp_extract_all(word, '\.')) AS letters FROM k, al)
SELECT word, with_period, without, round(-2 * (with_period * ln(q) + without * ln(1 - q) - with_period * ln(0.99::DOUBLE) - without * ln(0.01::DOUBLE)) * exp(-letters::DOUBLE) * (length(word) - letters + 1) * pow(letters::DOUBLE, -without::DOUBLE), 4) AS score FROM s""")
def abbreviation_scores(spark, sf_dir):
    return sentences.abbreviations(sentences.counted_alone(docs(spark, sf_dir)))


#: No SQL: boundaries depend on types by a trained table; a test holds them against cases of each kind.
@query()
def sentence_splits(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text")
    return sentences.split(d, written(sentences.model(d), "sentence-model")).select("doc_id", F.size("sentences").alias("n"), F.md5(F.array_join("sentences", "\n")).alias("digest"))
