"""DuckDB twins of the deterministic queries (the driver's correctness gate).

Each SQL string rebuilds the same posts from ``documents`` with the adapter formulas and then
computes the operator *independently* where that is natural (entropy from grouped
probabilities, PMI from explicit adjacent pairs), so a shared mistake is unlikely.
Floats are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from postcred.functions.features import DECEPTION_CATEGORIES
from postcred.functions.text import (DIGITS_ONLY_PATTERN, ENGLISH_STOPWORDS, LEXICON_WORD_PATTERN,
                                     NON_ALNUM_PATTERN, URL_PATTERN, WHITESPACE_CLASS)
from postcred.plans import fixtures as FX
from postcred.sources.lexicons import (FIXTURE_CATEGORY_INDEX_SQL, FIXTURE_SCORE_SQL,
                                       FIXTURE_SUBJECTIVITY_SQL)

K = "screen_name, created_at"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = WHITESPACE_CLASS
SW = ", ".join(lit(w) for w in ENGLISH_STOPWORDS)
DIGITS_FULL = DIGITS_ONLY_PATTERN.strip("^$")


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(chr(92) + 'A' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(WS + '+')}), lambda t: t <> '')"


def clean(x: str) -> str:
    s1 = f"list_filter({split(x)}, lambda t: lower(t) NOT IN ({SW}))"
    s2 = f"list_transform({s1}, lambda t: regexp_replace(lower(t), '[[:punct:]]', '', 'g'))"
    s3 = (f"list_filter({s2}, lambda t: length(t) > 2 AND NOT regexp_full_match(t, {lit(DIGITS_FULL)})"
          f" AND NOT contains(lower(t), 'https'))")
    return f"list_transform({s3}, lambda t: regexp_replace(t, {lit(NON_ALNUM_PATTERN)}, '', 'g'))"


def strip_urls(x: str) -> str:
    return f"regexp_replace({x}, {lit(URL_PATTERN)}, '', 'g')"


def strip_mentions(x: str) -> str:
    return f"array_to_string(list_filter({split(x)}, lambda w: NOT contains(w, '@')), ' ')"


def lex_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(LEXICON_WORD_PATTERN)})"


def r6(x: str) -> str:
    return f"(CAST(floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) AS DOUBLE) / 1e6 + 0.0)"


CREATED_AT = "strftime(TIMESTAMP '2018-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)), '%Y-%m-%d %H:%M:%S')"


def observations_cte(extra: int) -> str:
    return f"""SELECT source AS screen_name, {CREATED_AT} AS created_at,
      CAST((doc_id * 37) % 1000 AS BIGINT) AS followers_count,
      CAST(n_chars % 1500 + {extra} AS BIGINT) AS retweet_count,
      {strip('text')} AS text
    FROM documents
    WHERE doc_id IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL AND text IS NOT NULL"""


POSTS = f"posts AS ({observations_cte(10)})"
TOK = f"tok AS (SELECT {K}, {clean('text')} AS tokens FROM posts)"
STRIPPED = (f"stripped AS (SELECT {K}, {strip_mentions(strip_urls('text'))} AS text_stripped FROM posts), "
            f"kept AS (SELECT * FROM stripped WHERE text_stripped <> ''), "
            f"stok AS (SELECT {K}, {clean('text_stripped')} AS tokens FROM kept)")
STORED = f"ltok AS (SELECT {K}, {clean("replace(text, chr(10), '')")} AS tokens FROM posts)"
TERMS = "terms AS (SELECT DISTINCT t AS term FROM (SELECT unnest(tokens) AS t FROM tok) WHERE t <> '')"
SENT_LEX = (f"sent_lex AS (SELECT term, CAST({FIXTURE_SCORE_SQL} AS BIGINT) AS score FROM terms "
            f"WHERE {FIXTURE_SCORE_SQL} <> 0)")
SUBJ_LEX = f"subj_lex AS (SELECT term, CAST({FIXTURE_SUBJECTIVITY_SQL} AS DOUBLE) AS subjectivity FROM terms)"
CATS_LIST = "[" + ", ".join(lit(c) for c in DECEPTION_CATEGORIES) + "]"
CAT_LEX = f"cat_lex AS (SELECT {CATS_LIST}[{FIXTURE_CATEGORY_INDEX_SQL} + 1] AS category, term FROM terms)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def sentiment_ctes() -> list[str]:
    toks = (f"stoks AS (SELECT {K}, x.tok AS tok, x.pos AS pos FROM (SELECT {K}, "
            f"unnest(list_transform({split('text')}, lambda v, i: {{'tok': v, 'pos': i}})) AS x FROM posts))")
    words = f"swords AS (SELECT {K}, pos, unnest({lex_words('tok')}) AS term FROM stoks)"
    per_tok = (f"sper AS (SELECT {K}, pos, sum(score) AS s FROM swords JOIN sent_lex USING (term) "
               f"GROUP BY {K}, pos)")
    per_post = (f"spost AS (SELECT {K}, CAST(sum(greatest(s, 0)) AS BIGINT) AS positive, "
                f"CAST(sum(least(s, 0)) AS BIGINT) AS negative FROM sper GROUP BY {K})")
    sent = (f"sentiment AS (SELECT {K}, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, "
            f"CAST(0 AS BIGINT) AS neutral FROM posts LEFT JOIN spost USING ({K}))")
    return [toks, words, per_tok, per_post, sent]


def entropy_ctes(src: str = "tok", name: str = "entropy_t") -> list[str]:
    cnt = f"{name}_c AS (SELECT {K}, t, count(*) AS c FROM (SELECT {K}, unnest(tokens) AS t FROM {src}) GROUP BY {K}, t)"
    n = f"{name}_n AS (SELECT {K}, sum(c) AS n FROM {name}_c GROUP BY {K})"
    h = (f"{name}_h AS (SELECT {K}, -sum((c / n) * log2(c / n)) AS h FROM {name}_c JOIN {name}_n USING ({K}) "
         f"GROUP BY {K})")
    out = f"{name} AS (SELECT {K}, coalesce(h, 0.0) AS entropy FROM {src} LEFT JOIN {name}_h USING ({K}))"
    return [cnt, n, h, out]


def pmi_ctes(src: str = "stok") -> list[str]:
    pos = (f"ppos AS (SELECT {K}, n, x.w AS w, x.i AS i FROM (SELECT {K}, len(tokens) AS n, "
           f"unnest(list_transform(tokens, lambda v, i: {{'w': v, 'i': i}})) AS x FROM {src} WHERE len(tokens) >= 4))")
    big = (f"pbig AS (SELECT a.screen_name, a.created_at, a.n, a.w AS w1, b.w AS w2 FROM ppos a JOIN ppos b "
           f"ON a.screen_name = b.screen_name AND a.created_at = b.created_at AND b.i = a.i + 1)")
    uc = f"puc AS (SELECT {K}, w, count(*) AS c FROM ppos GROUP BY {K}, w)"
    bc = f"pbc AS (SELECT {K}, w1, w2, count(*) AS c FROM pbig GROUP BY {K}, w1, w2)"
    val = (f"pval AS (SELECT {K}, avg(log2((CAST(pbc.c AS DOUBLE) / (n - 1)) / "
           f"((CAST(u1.c AS DOUBLE) / n) * (CAST(u2.c AS DOUBLE) / n)))) AS pmi "
           f"FROM pbig JOIN pbc USING ({K}, w1, w2) "
           f"JOIN puc u1 ON u1.screen_name = pbig.screen_name AND u1.created_at = pbig.created_at AND u1.w = pbig.w1 "
           f"JOIN puc u2 ON u2.screen_name = pbig.screen_name AND u2.created_at = pbig.created_at AND u2.w = pbig.w2 "
           f"GROUP BY {K})")
    out = f"pmi_t AS (SELECT {K}, coalesce(pmi, 0.0) AS pmi FROM {src} LEFT JOIN pval USING ({K}))"
    return [pos, big, uc, bc, val, out]


def subjectivity_ctes() -> list[str]:
    w = f"subw AS (SELECT {K}, unnest({lex_words('text_stripped')}) AS term FROM kept)"
    a = f"suba AS (SELECT {K}, avg(subjectivity) AS subjectivity FROM subw JOIN subj_lex USING (term) GROUP BY {K})"
    out = f"subj AS (SELECT {K}, coalesce(subjectivity, 0.0) AS subjectivity FROM kept LEFT JOIN suba USING ({K}))"
    return [w, a, out]


def category_ctes() -> list[str]:
    w = (f"catw AS (SELECT {K}, len({lex_words('text_stripped')}) AS n_words, "
         f"unnest({lex_words('text_stripped')}) AS term FROM kept)")
    sums = ", ".join(
        f"CAST(sum(CASE WHEN category = {lit(c)} THEN 1 ELSE 0 END) AS DOUBLE) / n_words AS {c}"
        for c in DECEPTION_CATEGORIES)
    a = f"cata AS (SELECT {K}, {sums} FROM catw JOIN cat_lex USING (term) GROUP BY {K}, n_words)"
    cols = ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in DECEPTION_CATEGORIES)
    out = f"cats AS (SELECT {K}, {cols} FROM kept LEFT JOIN cata USING ({K}))"
    dec = ("deception + money + hate + envy + crime + magic + fear + lust + power / 8")
    d = f"dec AS (SELECT {K}, {dec} AS deception_index FROM cats)"
    return [w, a, out, d]


def topic_ctes() -> list[str]:
    """Fixture topic tables (see ``postcred.plans.fixtures``) and the marginal word weights."""
    k = FX.FIXTURE_TOPICS
    ws = ", ".join(FX.theta_weight_sql(t, "text") for t in range(k))
    dt = (f"dtop AS (SELECT {K}, x.p AS prob, x.i - 1 AS topic_id FROM (SELECT {K}, "
          f"unnest(list_transform([{ws}], lambda v, i: {{'p': v, 'i': i}})) AS x FROM posts))")
    dtn = f"dtopn AS (SELECT {K}, topic_id, prob / sum(prob) OVER (PARTITION BY {K}) AS prob FROM dtop)"
    lterms = "lterms AS (SELECT DISTINCT t AS term FROM (SELECT unnest(tokens) AS t FROM ltok) WHERE t <> '')"
    phis = ", ".join(FX.phi_weight_sql(t, "term") for t in range(k))
    tt = (f"tterm AS (SELECT term, x.i - 1 AS topic_id, x.p AS raw FROM (SELECT term, "
          f"unnest(list_transform([{phis}], lambda v, i: {{'p': v, 'i': i}})) AS x FROM lterms))")
    ttn = "ttermn AS (SELECT topic_id, term, raw / sum(raw) OVER (PARTITION BY topic_id) AS weight FROM tterm)"
    mt = "mtheta AS (SELECT topic_id, sum(prob) / (SELECT count(*) FROM posts) AS m FROM dtopn GROUP BY topic_id)"
    ww = "wweight AS (SELECT term, sum(m * weight) AS weight FROM ttermn JOIN mtheta USING (topic_id) GROUP BY term)"
    dw = (f"dweight AS (SELECT {K}, sum(weight) AS topic_weight FROM (SELECT {K}, unnest(tokens) AS term FROM ltok) "
          f"JOIN wweight USING (term) GROUP BY {K})")
    tw = f"tweight AS (SELECT {K}, coalesce(topic_weight, 0.0) AS topic_weight FROM posts LEFT JOIN dweight USING ({K}))"
    return [dt, dtn, lterms, tt, ttn, mt, ww, dw, tw]


NFRQ = ("CASE WHEN retweet_count > 0 THEN greatest(CAST(retweet_count - followers_count AS DOUBLE) / retweet_count, 0.0) "
        "ELSE 0.0 END")


def five_ctes() -> list[str]:
    """nfrq, positive, negative, entropy, topic_weight per post (as doubles)."""
    five = (f"five AS (SELECT {K}, {NFRQ} AS nfrq, CAST(positive AS DOUBLE) AS positive, "
            f"CAST(negative AS DOUBLE) AS negative, entropy, topic_weight FROM posts "
            f"JOIN sentiment USING ({K}) JOIN entropy_t USING ({K}) JOIN tweight USING ({K}))")
    return ([POSTS, TOK, TERMS, SENT_LEX, STORED] + sentiment_ctes() + entropy_ctes() + topic_ctes() + [five])


FEATS = ("nfrq", "positive", "negative", "entropy", "topic_weight")


def standardized_ctes() -> list[str]:
    absd = f"absf AS (SELECT {K}, " + ", ".join(f"abs({c}) AS {c}" for c in FEATS) + " FROM five)"
    st = "fstats AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
        for c in FEATS) + " FROM absf)"
    z = f"zf AS (SELECT {K}, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATS) + " FROM absf, fstats)"
    return five_ctes() + [absd, st, z]


def select_r6(src: str, cols, key: str = K) -> str:
    return f"SELECT {key}, " + ", ".join(f"{r6(c)} AS {c}" for c in cols) + f" FROM {src}"


def memberships_sql(centers, src: str = "zf") -> str:
    d = []
    for j, c in enumerate(centers):
        s = " + ".join(f"pow({f} - ({v!r}), 2)" for f, v in zip(FEATS, c))
        d.append(f"pow(greatest(sqrt({s}), 2.220446049250313e-16), -2.0) AS i{j}")
        d.append(f"({s}) AS d{j}")
    inner = f"SELECT {K}, " + ", ".join(d) + f" FROM {src}"
    k = len(centers)
    tot = " + ".join(f"i{j}" for j in range(k))
    us = ", ".join(f"i{j} / ({tot}) AS u{j}" for j in range(k))
    mid = f"SELECT {K}, {us}, " + ", ".join(f"d{j}" for j in range(k)) + f" FROM ({inner})"
    mx = "greatest(" + ", ".join(f"u{j}" for j in range(k)) + ")"
    arg = "CASE " + " ".join(f"WHEN u{j} = {mx} THEN {j}" for j in range(k)) + " END"
    dmin = "least(" + ", ".join(f"d{j}" for j in range(k)) + ")"
    km = "CASE " + " ".join(f"WHEN d{j} = {dmin} THEN {j}" for j in range(k)) + " END"
    return (f"SELECT {K}, " + ", ".join(f"{r6(f'u{j}')} AS u{j}" for j in range(k))
            + f", {r6(mx)} AS max_membership, CAST({arg} AS INTEGER) AS fuzzy_label, "
            f"CAST({km} AS INTEGER) AS kmeans_label FROM ({mid})")
