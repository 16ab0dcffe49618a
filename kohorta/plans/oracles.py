"""Reference SQL (DuckDB) for the registered queries.

Written independently of them, but for the contraction table and the patterns below,
which are fixed values taken over.

Dates are compared as text; similarities, ratios and coefficients to six digits.
"""

from __future__ import annotations

import json
from pathlib import Path

from kohorta.functions.text import CONTRACTIONS
from kohorta.sources import settings

# --- building blocks -------------------------------------------------------------

_VEC = """
vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""

_CONCEPTS = _VEC + """,
con AS (SELECT 'c' || id AS concept, e, round(0.15 + 0.01 * id, 2)::DOUBLE AS threshold
        FROM vec WHERE id < 10)"""

_SCORES = _CONCEPTS + """,
scores AS (SELECT vec.id, con.concept, con.threshold,
                  round(list_cosine_similarity(vec.e, con.e), 6) + 0.0 AS similarity
           FROM vec, con)"""

_STUDY = _VEC + """,
sim AS (SELECT v.id AS vec_id,
               round(list_cosine_similarity(v.e, x.e), 6) + 0.0 AS sx,
               round(list_cosine_similarity(v.e, y.e), 6) + 0.0 AS sy,
               round(list_cosine_similarity(v.e, k.e), 6) + 0.0 AS sk
        FROM vec v, vec x, vec y, vec k WHERE x.id = 0 AND y.id = 1 AND k.id = 2),
st AS (SELECT user_id, event_id AS id, ts AS created_ts, sx, sy, sk,
              DATE '2019-01-01'
                + CAST(30 * datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER)
                AS normalised_date
       FROM events JOIN sim ON vec_id = event_id % (SELECT count(*) FROM embeddings))"""

_DECORATED = """
dec AS (SELECT doc_id AS id, lang,
  (CASE WHEN doc_id % 10 = 0 THEN 'RT ' ELSE '' END) || '@user_' || (doc_id % 7) || ' '
  || (CASE doc_id % 4 WHEN 0 THEN 'I''m sure they can''t, ' WHEN 1 THEN 'we don’t … ' ELSE '' END)
  || (CASE WHEN doc_id % 6 = 0 THEN 'my #t1d ' ELSE '' END)
  || (CASE WHEN doc_id % 5 = 0 THEN '😀 ❤ ' ELSE '' END) || text
  || (CASE WHEN doc_id % 3 = 0 THEN ' https://t.co/x' || doc_id || ' tail' ELSE '' END) AS text
  FROM documents)"""

_POSTS = _STUDY + "," + _DECORATED + """,
posts AS (SELECT st.*, dec.text, dec.lang FROM st JOIN dec
          ON dec.id = st.id % (SELECT count(*) FROM documents))"""

_BLANK = r"[\t-\r \x1c-\x1f\x85\p{Z}]"


def _periods(source: str, min_posts: int, scope: str = "period") -> str:
    """Periods of the cohort, from the table ``source``."""
    outcome = "max(CASE WHEN d = od THEN 1 ELSE 0 END)" if scope == "period" else "max(hit)"
    return f"""
usr AS (SELECT user_id, min(normalised_date) AS t0, max(normalised_date) AS tn,
               min(normalised_date) FILTER (sy >= 0.25) AS od
        FROM {source} GROUP BY user_id HAVING count(*) > {min_posts}),
bound AS (SELECT user_id, 1 AS k, tn,
                 CAST(t0 + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS hi FROM usr
          UNION ALL
          SELECT user_id, k + 1, tn, CAST(hi + INTERVAL 3 MONTH AS DATE) FROM bound WHERE hi < tn),
kept AS (SELECT p.user_id, p.normalised_date AS d, p.sx, u.od,
                CASE WHEN u.od IS NULL THEN 0 ELSE 1 END AS hit,
                (SELECT min(k) FROM bound b WHERE b.user_id = p.user_id
                 AND b.hi >= p.normalised_date) AS quarter
         FROM {source} p JOIN usr u ON u.user_id = p.user_id
         WHERE u.od IS NULL OR p.normalised_date <= u.od),
per AS (SELECT user_id, CAST(quarter AS INTEGER) AS quarter, min(d) AS d_t0, max(d) AS date_tn,
               CAST(max(CASE WHEN sx >= 0.20 THEN 1 ELSE 0 END) AS INTEGER) AS exposition,
               CAST({outcome} AS INTEGER) AS outcome
        FROM kept GROUP BY user_id, quarter)"""


_INTERVALS = """
dur AS (SELECT *, CAST(date_tn - d_t0 AS BIGINT) AS delta FROM per),
run AS (SELECT a.user_id, a.quarter, a.exposition, a.outcome, a.delta,
               (SELECT CAST(sum(b.delta) AS BIGINT) FROM dur b
                WHERE b.user_id = a.user_id AND b.quarter <= a.quarter) AS stop,
               (SELECT min(b.quarter) FROM dur b
                WHERE b.user_id = a.user_id AND b.outcome = 1) AS ev
        FROM dur a),
iv AS (SELECT user_id, quarter, stop - delta AS start, stop, exposition, outcome FROM run
       WHERE (ev IS NULL OR quarter <= ev) AND NOT (stop = delta AND delta = 0))"""

_COHORT = _STUDY + "," + _periods("st", 50)
_IV = _COHORT + "," + _INTERVALS

_RISK = _IV + """,
risk AS (SELECT e.t, count(*) AS n, count(*) FILTER (i.exposition = 1) AS n1,
                count(*) FILTER (i.outcome = 1 AND i.stop = e.t) AS d,
                count(*) FILTER (i.outcome = 1 AND i.stop = e.t AND i.exposition = 1) AS d1
         FROM (SELECT DISTINCT stop AS t FROM iv WHERE outcome = 1 AND start < stop) e
         JOIN iv i ON i.start < e.t AND e.t <= i.stop GROUP BY e.t)"""

_COX = _RISK + """,
tie AS (SELECT risk.*, CAST(l AS DOUBLE) / d AS f FROM risk, unnest(range(d)) AS u(l)),
newton AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS b
  UNION ALL
  SELECT step + 1,
         b + ((SELECT sum(d1) FROM risk)
              - sum((n1 - f * d1) * exp(b) / (n - n1 + n1 * exp(b) - f * (d - d1 + d1 * exp(b)))))
           / sum((n1 - f * d1) * exp(b) / (n - n1 + n1 * exp(b) - f * (d - d1 + d1 * exp(b)))
                 * (1 - (n1 - f * d1) * exp(b)
                        / (n - n1 + n1 * exp(b) - f * (d - d1 + d1 * exp(b)))))
  FROM newton, tie WHERE step < 10 GROUP BY step, b),
est AS (SELECT b AS coef FROM newton WHERE step = 10),
inf AS (SELECT coef, 1 / sqrt(sum(q * (1 - q))) AS se FROM (
          SELECT coef, (n1 - f * d1) * exp(coef)
                 / (n - n1 + n1 * exp(coef) - f * (d - d1 + d1 * exp(coef))) AS q FROM est, tie)
        GROUP BY coef)"""


def _normal_tail(z: str) -> str:
    """Both tails beyond ``z``, by Simpson's rule because the engine has no error function."""
    return f"""(1 - 2 * (SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                             * exp(-0.5 * pow(abs({z}) * i / 2000, 2)))
                      FROM range(2001) AS r(i)) * abs({z}) / 6000 / sqrt(2 * pi()))"""


def _summary(source: str) -> str:
    """Summary columns from ``source(covariate, coef, se)``."""
    return f"""
SELECT covariate, round(coef, 6) AS coef, round(exp(coef), 6) AS exp_coef, round(se, 6) AS se,
       round(coef - 1.959963984540054 * se, 6) AS ci_low,
       round(coef + 1.959963984540054 * se, 6) AS ci_high, round(coef / se, 6) AS z,
       round(exp(coef - 1.959963984540054 * se), 6) AS exp_low,
       round(exp(coef + 1.959963984540054 * se), 6) AS exp_high,
       round({_normal_tail('coef / se')}, 6) AS p,
       round(-log2({_normal_tail('coef / se')}), 6) AS minus_log2_p
FROM {source}"""


# Two covariates: exposition (a) and period number (q), risk sets by range join.
_COX2 = _IV + """,
use AS (SELECT CAST(exposition AS DOUBLE) AS a, CAST(quarter AS DOUBLE) AS q, start, stop, outcome
        FROM iv WHERE start < stop),
tm AS (SELECT stop AS t, CAST(count(*) AS DOUBLE) AS d, sum(a) AS da, sum(q) AS dq
       FROM use WHERE outcome = 1 GROUP BY stop),
pair AS (SELECT tm.t, tm.d, a, q, CASE WHEN outcome = 1 AND stop = tm.t THEN 1 ELSE 0 END AS ev
         FROM tm JOIN use ON start < tm.t AND tm.t <= stop),
fr AS (SELECT t, d, l / d AS f FROM tm, unnest(range(CAST(d AS BIGINT))) AS u(l)),
newton AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS ba, CAST(0 AS DOUBLE) AS bq,
         CAST(0 AS DOUBLE) AS haa, CAST(0 AS DOUBLE) AS haq, CAST(0 AS DOUBLE) AS hqq
  UNION ALL
  SELECT step + 1, ba + (ga * hqq - gq * haq) / (haa * hqq - haq * haq),
         bq + (gq * haa - ga * haq) / (haa * hqq - haq * haq), haa, haq, hqq
  FROM (SELECT step, ba, bq,
               (SELECT sum(da) FROM tm) - sum(za / s) AS ga,
               (SELECT sum(dq) FROM tm) - sum(zq / s) AS gq,
               sum(zaa / s - za * za / (s * s)) AS haa, sum(zaq / s - za * zq / (s * s)) AS haq,
               sum(zqq / s - zq * zq / (s * s)) AS hqq
        FROM (SELECT step, ba, bq, r.t, f, sum((1 - f * ev) * w) AS s, sum((1 - f * ev) * w * a) AS za,
                     sum((1 - f * ev) * w * q) AS zq, sum((1 - f * ev) * w * a * a) AS zaa,
                     sum((1 - f * ev) * w * a * q) AS zaq, sum((1 - f * ev) * w * q * q) AS zqq
              FROM (SELECT step, ba, bq, t, a, q, ev, exp(ba * a + bq * q) AS w
                    FROM newton, pair WHERE step < 12) r JOIN fr ON fr.t = r.t
              GROUP BY step, ba, bq, r.t, f) per_tie
        GROUP BY step, ba, bq) sums),
est AS (SELECT 'exposition' AS covariate, ba AS coef, sqrt(hqq / (haa * hqq - haq * haq)) AS se
        FROM newton WHERE step = 12
        UNION ALL
        SELECT 'quarter', bq, sqrt(haa / (haa * hqq - haq * haq)) FROM newton WHERE step = 12)"""

# --- text ------------------------------------------------------------------------

# The token pattern and the literal replacements of the text queries.
_TOKEN = (
    r"https?://\S+|www\.\S+|(?:\+?[01][ *.)-]*)?(?:\(?\p{Nd}{3}[ *.)-]*)?\p{Nd}{3}[ *.)-]*\p{Nd}{4}"
    r"|[<>]?[:;=8][-o*'']?[)\](\[dDpP/:}{@|\\]|[)\](\[dDpP/:}{@|\\][-o*'']?[:;=8][<>]?|</?3"
    r"|<[^>\s]+>|-+>|<-+|@[\p{L}\p{N}_]+|#+[\p{L}\p{N}_]+[\p{L}\p{N}_''-]*[\p{L}\p{N}_]+"
    r"|[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]*[\p{L}\p{N}_]"
    r"|\p{L}[\p{L}''_-]+\p{L}|[+-]?\p{N}+[,/.:-]\p{N}+[+-]?|[\p{L}\p{N}_]+|\.(?:\s*\.)+|\S"
)

_REFERENCED = _DECORATED + """,
ref AS (SELECT id, replace(replace(replace(replace(replace(
          text || ' &lt;3 R&amp;D &quot;x&quot; I&#39;m at me.you@b-c.org. '
            || 'go -> or <-- <b>now</b> (: D-8> </3 +1 (555) 123-4567, 555 1234 12345678 #covid-19''s #a #1-', '&lt;', '<'),
          '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS text FROM dec)"""

_NORMAL_TOKENS = f"""
tok AS (SELECT id, array_to_string(list_transform(
          regexp_extract_all(replace(replace(text, '’', ''''), '…', '...'), '{_TOKEN}'),
          lambda t: CASE WHEN t[1] = '@' THEN '@USER'
                         WHEN starts_with(lower(t), 'http') OR starts_with(lower(t), 'www')
                           THEN 'HTTPURL'
                         WHEN t = '😀' THEN ':grinning_face:' WHEN t = '❤' THEN ':red_heart:'
                         WHEN t = '©' THEN ':copyright:' WHEN t = '®' THEN ':registered:'
                         ELSE t END), ' ') AS s FROM ref)"""


def _replaced(column: str) -> str:
    for old, new in [
        ("cannot ", "can not "), ("n't ", " n't "), ("n 't ", " n't "), ("ca n't", "can't"),
        ("ai n't", "ain't"), ("'m ", " 'm "), ("'re ", " 're "), ("'s ", " 's "),
        ("'ll ", " 'll "), ("'d ", " 'd "), ("'ve ", " 've "), (" p . m .", "  p.m."),
        (" p . m ", " p.m "), (" a . m .", " a.m."), (" a . m ", " a.m "),
    ]:
        old, new = old.replace("'", "''"), new.replace("'", "''")
        column = f"replace({column}, '{old}', '{new}')"
    for pattern, new in [
        (",([0-9]{2,4}) , ([0-9]{2,4})", r",\1,\2"),
        ("([0-9]{1,3}) / ([0-9]{2,4})", r"\1/\2"),
        ("([0-9]{1,3})- ([0-9]{2,4})", r"\1-\2"),
    ]:
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return f"trim(regexp_replace({column}, '{_BLANK}+', ' ', 'g'))"


def _contraction_map() -> str:
    pairs = ", ".join(
        "'" + k.replace("'", "''") + "': '" + v + "'" for k, v in CONTRACTIONS.items()
    )
    return "MAP {" + pairs + "}"


def _expanded(column: str) -> str:
    key = "lower(replace(t, '’', ''''))"
    return f"""array_to_string(list_transform(
      regexp_extract_all({column}, '\\p{{L}}+(?:[''’]\\p{{L}}+)*|[^\\p{{L}}]+'),
      lambda t: CASE WHEN m[{key}] IS NULL THEN t
                     WHEN t[1] <> lower(t[1]) THEN upper(m[{key}][1]) || m[{key}][2:]
                     ELSE m[{key}] END), '')"""


_CLEAN = f"""
cut AS (SELECT *, split_part(text, 'https://', 1) AS c FROM {{source}}),
prepared AS (SELECT *, regexp_replace(c, '@[\\p{{{{L}}}}\\p{{{{N}}}}_]+', '', 'g') AS prep FROM cut
             WHERE c NOT LIKE 'RT @%'),
counted AS (SELECT *, len(regexp_extract_all(prep, '[^\\t-\\r \\x1c-\\x1f\\x85\\p{{{{Z}}}}]+')) AS n_tokens
            FROM prepared),
clean AS (SELECT * FROM counted WHERE n_tokens > 7)"""


_PART = """
  CASE WHEN CAST('0x' || substr(md5(doc_id || ':42'), 1, 8) AS BIGINT) % 100 < 33 THEN 'test'
       WHEN CAST('0x' || substr(md5(doc_id || ':42'), 9, 8) AS BIGINT) % 100 < 20 THEN 'validation'
       ELSE 'train' END"""

_COHORT_ROWS = """
SELECT user_id, quarter, CAST(d_t0 AS VARCHAR) AS d_t0, CAST(date_tn AS VARCHAR) AS date_tn,
       exposition, outcome FROM per"""

_ENTRY = """
hit AS (SELECT user_id, min(ROW(created_ts, id)) AS first FROM {source}
        WHERE sk >= 0.33 OR contains({column}, '#t1d') GROUP BY user_id),
entered AS (SELECT p.* FROM {source} p JOIN hit USING (user_id)
            WHERE ROW(p.created_ts, p.id) >= hit.first)"""

_METRICS = """
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision,
       CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall,
       CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1
FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp,
             count(*) FILTER (quality = 0 AND toxic = 0) AS fp,
             count(*) FILTER (quality = 1 AND toxic = 1) AS fn,
             count(*) FILTER (quality = 0 AND toxic = 1) AS tn
      FROM labels JOIN documents USING (doc_id))"""

_STREAMED = """
SELECT event_id AS id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_ts,
       'saw a ' || event_type AS text FROM events WHERE event_type <> 'error'
UNION ALL SELECT -3 * event_id - 3, user_id, '2015-01-05 10:00:00', 'an old view'
FROM events WHERE event_type = 'error'
UNION ALL SELECT 1125899906842624, max(user_id), '2098-01-06 10:00:00', 'a far view' FROM events"""

_ENCODED = _CONCEPTS + """,
enc AS (SELECT 'dense' AS encoder, vec.id, con.concept,
               round(list_cosine_similarity(vec.e, con.e), 6) + 0.0 AS similarity FROM vec, con
        UNION ALL
        SELECT 'sign', vec.id, con.concept,
               round(list_cosine_similarity(list_transform(vec.e, lambda x: CAST(sign(x) AS DOUBLE)),
                     list_transform(con.e, lambda x: CAST(sign(x) AS DOUBLE))), 6) + 0.0
        FROM vec, con)"""


def _weights(counts: str, name: str, key: str) -> str:
    """Unit TF-IDF weights ``name(key, bucket, w)`` of the counts, by the texts' frequencies."""
    return f"""
{name}_raw AS (SELECT c.{key}, c.bucket, c.n * ln(((SELECT count(*) FROM documents) + 1)
                 / (coalesce(f.d, 0) + 1.0)) AS w FROM {counts} c LEFT JOIN freq f USING (bucket)),
{name} AS (SELECT {key}, bucket, CASE WHEN sum(w * w) OVER (PARTITION BY {key}) > 0
             THEN w / sqrt(sum(w * w) OVER (PARTITION BY {key})) ELSE 0.0 END AS w FROM {name}_raw)"""


def _buckets(source: str, key: str, text: str) -> str:
    return rf"""(SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 262144 AS bucket, count(*) AS n
      FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+')) AS t FROM {source})
      WHERE t <> '' GROUP BY ALL)"""


_TFIDF = f"""
tc AS {_buckets('dec', 'id', 'text')},
freq AS (SELECT bucket, count(*) AS d FROM tc GROUP BY bucket),
{_weights('tc', 'tw', 'id')}"""


def _settings() -> dict:
    return json.loads(Path(settings.DIABETES).read_text(encoding="utf-8"))


def _score_texts() -> str:
    named = _settings()["concept_keywords"]
    values = ", ".join(
        "('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in named.items()
    )
    return f"""WITH {_DECORATED}, {_TFIDF},
    con AS (SELECT * FROM (VALUES {values}) AS v(concept, words)),
    cc AS {_buckets('con', 'concept', 'words')},
    {_weights('cc', 'cw', 'concept')},
    prod AS (SELECT id, concept, sum(tw.w * cw.w) AS s FROM tw JOIN cw USING (bucket) GROUP BY ALL)
    SELECT dec.id, con.concept, round(coalesce(s, 0.0), 6) + 0.0 AS similarity
    FROM dec CROSS JOIN con LEFT JOIN prod ON prod.id = dec.id AND prod.concept = con.concept"""


def oracle_sql() -> dict[str, str]:
    words = _settings()
    track, entry = words["track"], words["entry_keywords"]
    in_track = " OR ".join(f"contains(lower(text), '{w}')" for w in track)
    in_entry = " OR ".join(f"contains(text, '{w}')" for w in entry)
    clean_raw = _CLEAN.format(source="dec")
    chain = _CLEAN.format(source="posts")
    return {
        "build_cohort": f"WITH RECURSIVE {_COHORT} {_COHORT_ROWS}",
        "build_cohort_user_scope": (
            f"WITH RECURSIVE {_STUDY}, {_periods('st', 50, 'user')} {_COHORT_ROWS}".replace(
                "HAVING count(*) >", "HAVING count(*) + count(*) FILTER (id % 2 = 0) >"
            )
        ),
        "csv_period_table": f"WITH RECURSIVE {_COHORT} {_COHORT_ROWS}",
        "cox_intervals": f"WITH RECURSIVE {_IV} SELECT * FROM iv",
        "risk_table": f"WITH RECURSIVE {_RISK} SELECT * FROM risk",
        "cox_fit": f"""WITH RECURSIVE {_COX},
            ll AS (SELECT (SELECT sum(d1) FROM risk) * coef - sum(ln(n - n1 + n1 * exp(coef)
                            - f * (d - d1 + d1 * exp(coef)))) AS value FROM est, tie GROUP BY coef),
            ll0 AS (SELECT -sum(ln(n - f * d)) AS value FROM tie)
            SELECT (SELECT count(DISTINCT user_id) FROM iv WHERE start < stop) AS subjects,
                   (SELECT count(*) FROM iv WHERE start < stop) AS intervals,
                   (SELECT CAST(sum(d) AS BIGINT) FROM risk) AS events,
                   (SELECT count(*) FROM iv WHERE outcome = 1 AND start = stop) AS dropped_events,
                   round(ll.value, 6) AS log_likelihood,
                   round(2 - 2 * ll.value, 6) AS partial_aic,
                   round(2 * (ll.value - ll0.value), 6) AS likelihood_ratio,
                   1 AS degrees_of_freedom,
                   round({_normal_tail('sqrt(2 * (ll.value - ll0.value))')}, 6) AS likelihood_ratio_p
            FROM ll, ll0""",
        "cox_summary": f"WITH RECURSIVE {_COX} "
        + _summary("(SELECT 'exposition' AS covariate, coef, se FROM inf)"),
        "cox_two_covariates": f"WITH RECURSIVE {_COX2} " + _summary("est"),
        "assign_periods": f"""WITH RECURSIVE {_STUDY}, {_periods('st', 0)}
            SELECT user_id, id, CAST(normalised_date AS VARCHAR) AS normalised_date,
                   CAST(q AS INTEGER) AS quarter, 'Q' || q AS quarter_name
            FROM (SELECT *, (SELECT min(k) FROM bound b WHERE b.user_id = st.user_id
                             AND b.hi >= st.normalised_date) AS q FROM st)""",
        "define_t0": f"""WITH {_POSTS}, timed AS (SELECT * FROM posts WHERE id % 7 <> 0),
            {_ENTRY.format(source='timed', column='text')}
            SELECT user_id, id, CAST(normalised_date AS VARCHAR) AS normalised_date FROM entered""",
        "truncate_at_outcome": f"""WITH {_STUDY},
            od AS (SELECT user_id, min(normalised_date) AS d FROM st WHERE sy >= 0.25 GROUP BY 1)
            SELECT user_id, id, CAST(normalised_date AS VARCHAR) AS normalised_date, sy
            FROM st LEFT JOIN od USING (user_id) WHERE d IS NULL OR normalised_date <= d""",
        "min_timeline": """SELECT user_id, event_id AS id FROM (
            SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n > 50""",
        "timeline_span": f"""WITH {_STUDY}
            SELECT user_id, CAST(min(normalised_date) AS VARCHAR) AS t0,
                   CAST(max(normalised_date) AS VARCHAR) AS tn, count(*) AS n_posts
            FROM st GROUP BY user_id""",
        "timeline_positions": """SELECT user_id, event_id AS id,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position
            FROM events""",
        "score_concepts": f"WITH {_SCORES} SELECT id, concept, similarity FROM scores",
        "pivot_scores": f"WITH {_SCORES} SELECT id, "
        + ", ".join(f"max(similarity) FILTER (concept = 'c{i}') AS c{i}" for i in range(10))
        + " FROM scores GROUP BY id",
        "compare_encoders": f"WITH {_ENCODED} SELECT * FROM enc",
        "encoder_summary": f"""WITH {_ENCODED} SELECT encoder, concept, count(*) AS n,
            min(similarity) AS min_similarity, round(median(similarity), 6) + 0.0 AS median_similarity,
            max(similarity) AS max_similarity FROM enc GROUP BY encoder, concept""",
        "top_k_per_concept": f"""WITH {_SCORES} SELECT id, concept, similarity, CAST(r AS INTEGER) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY similarity DESC, id) AS r
                  FROM scores) WHERE r <= 50""",
        "screen_thresholds": f"""WITH {_SCORES}, {_DECORATED}
            SELECT id, concept, similarity, CAST(r AS INTEGER) AS rank, text
            FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY similarity DESC, id) AS r
                  FROM scores) JOIN dec USING (id) WHERE r <= 50""",
        "apply_thresholds": f"WITH {_SCORES} SELECT * FROM scores WHERE similarity >= threshold",
        "neighbour_cosine": f"""WITH {_VEC} SELECT a.id,
            round(list_cosine_similarity(a.e, b.e), 6) + 0.0 AS similarity
            FROM vec a JOIN vec b ON b.id = a.id + 1""",
        "latest_per_user": """SELECT user_id, event_id AS id, event_type, value FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
            WHERE r <= 20""",
        "latest_per_user_paged": """SELECT user_id, event_id AS id, event_type, value FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""",
        "build_timelines": f"""WITH {_POSTS} SELECT user_id, id, CAST(length(text) AS INTEGER) AS n FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM posts
            WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000))
            WHERE r <= 20 AND text NOT LIKE 'RT @%'""",
        "keep_existing": """SELECT DISTINCT user_id FROM events
            WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)""",
        "append_new": "SELECT event_id AS id, user_id, event_type, value FROM events",
        "dedup_posts": "SELECT doc_id AS id, lang, text, 0 AS seq FROM documents",
        "clean_text": f"""WITH {_DECORATED}, {clean_raw}
            SELECT id, prep, CAST(n_tokens AS INTEGER) AS n_tokens FROM clean""",
        "expand_contractions": f"""WITH {_DECORATED}, mp AS (SELECT {_contraction_map()} AS m)
            SELECT id, {_expanded('text')} AS text FROM dec, mp""",
        "tokenize_post": f"""WITH {_REFERENCED},
            t AS (SELECT id, regexp_extract_all(text, '{_TOKEN}') AS l FROM ref)
            SELECT id, CAST(len(l) AS INTEGER) AS n_tokens, array_to_string(l, '|') AS tokens FROM t""",
        "normalize_token": f"""WITH {_REFERENCED} SELECT id, array_to_string(list_transform(
            regexp_extract_all(text, '{_TOKEN}'),
            lambda t: CASE WHEN t[1] = '@' THEN '@USER'
                           WHEN starts_with(lower(t), 'http') OR starts_with(lower(t), 'www')
                             THEN 'HTTPURL'
                           WHEN t = '😀' THEN ':grinning_face:' WHEN t = '❤' THEN ':red_heart:'
                           WHEN t = '©' THEN ':copyright:' WHEN t = '®' THEN ':registered:'
                           WHEN t = '’' THEN '\'\'' WHEN t = '…' THEN '...'
                           ELSE t END), ' ') AS tokens FROM ref""",
        "normalize_post": f"""WITH {_REFERENCED}, {_NORMAL_TOKENS}
            SELECT id, {_replaced('s')} AS text FROM tok""",
        "keyword_track": f"""WITH {_DECORATED} SELECT id, lang FROM dec
            WHERE contains(lower(text), '#t1d') OR contains(lower(text), 'sure they')""",
        "study_track": f"WITH {_DECORATED} SELECT id, ({in_entry}) AS entry FROM dec WHERE {in_track}",
        "apply_translations": """SELECT doc_id AS id, lang,
            CASE WHEN lang IN ('fr', 'de') THEN '[en] ' || text ELSE text END AS text FROM documents""",
        "translate_texts": """SELECT doc_id AS id, lang,
            CASE WHEN lang = 'en' THEN text ELSE '[' || coalesce(lang, 'None') || '] ' || text END AS text
            FROM documents""",
        "filter_lang": "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en'",
        "label_counts": "SELECT quality, count(*) AS count FROM labels GROUP BY quality",
        "distinct_users": "SELECT DISTINCT user_id FROM events",
        "sample_head": """SELECT event_id, user_id, event_type, value FROM events
            ORDER BY event_id LIMIT 1000""",
        "day_normalise": """SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS normalised_date
            FROM events""",
        "split_examples": f"SELECT doc_id AS id, {_PART} AS part FROM labels",
        "binary_metrics": _METRICS,
        "classifier_gradient": f"""WITH part AS (SELECT {_PART} AS part FROM labels JOIN documents USING (doc_id))
            SELECT block, 0.0::DOUBLE AS gradient, (SELECT count(*) FROM part WHERE part = 'train') AS examples
            FROM generate_series(0, 64) AS g(block)""",
        "reload_classifier": "SELECT doc_id AS id, TRUE AS same FROM documents",
        "evaluate_stored": f"""SELECT count(*) AS examples, sum(quality)::BIGINT AS positives, count(*) AS counted,
            TRUE AS agrees FROM (SELECT quality, {_PART} AS part FROM labels JOIN documents USING (doc_id))
            WHERE part = 'test'""",
        "softmax_class": """WITH h AS (SELECT vec_id AS id,
            list_reduce(CAST(embedding[1:32] AS DOUBLE[]), lambda x, y: x + y) AS a,
            list_reduce(CAST(embedding[33:64] AS DOUBLE[]), lambda x, y: x + y) AS b FROM embeddings),
            p AS (SELECT id, 1 / (1 + exp(b - a)) AS p0, 1 / (1 + exp(a - b)) AS p1 FROM h)
            SELECT id, round(p0, 6) AS p0, round(p1, 6) AS p1,
                   CASE WHEN p0 < 0.5 AND p1 >= 0.5 THEN 1 ELSE 0 END AS personal FROM p""",
        "choose_candidate": f"""WITH h AS (SELECT vec_id,
            list_reduce(CAST(embedding[1:32] AS DOUBLE[]), lambda x, y: x + y) AS a,
            list_reduce(CAST(embedding[33:64] AS DOUBLE[]), lambda x, y: x + y) AS b FROM embeddings),
            part AS (SELECT doc_id, quality AS label, {_PART} AS part FROM labels),
            cut AS (SELECT CAST(unnest(generate_series(1, 9)) AS INTEGER) AS candidate),
            cell AS (SELECT candidate, label, 1 / (1 + exp(a - b)) >= candidate / 10 AS hit FROM part
                JOIN h ON vec_id = doc_id % (SELECT count(*) FROM embeddings), cut WHERE part = 'validation'),
            c AS (SELECT candidate, count(*) FILTER (label = 1 AND hit) AS tp,
                count(*) FILTER (label = 0 AND hit) AS fp, count(*) FILTER (label = 1 AND NOT hit) AS fn,
                count(*) FILTER (label = 0 AND NOT hit) AS tn FROM cell GROUP BY candidate),
            m AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
                CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
                CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)
            SELECT candidate, tp, fp, fn, tn, round(accuracy, 6) + 0.0 AS accuracy,
                round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall,
                round(f1, 6) + 0.0 AS f1,
                row_number() OVER (ORDER BY m.f1 DESC, m.accuracy DESC, candidate) = 1 AS chosen FROM m""",
        "network_classes": """WITH x AS (SELECT doc_id AS id,
            length(t) - length(replace(t, 'e', '')) AS e, length(t) - length(replace(t, ' ', '')) AS s
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
            h AS (SELECT id, greatest(3 * e - 4 * s + 10, 0) AS a, greatest(5 * s - 2 * e - 20, 0) AS b,
                greatest(e + 2 * s + 5, 0) AS c FROM x),
            o AS (SELECT id, CAST(a + 2 * b - c + 7 AS DOUBLE) AS o0, CAST(b - a + 3 * c - 3 AS DOUBLE) AS o1 FROM h)
            SELECT id, o0, o1, CASE WHEN o1 > o0 THEN 1 ELSE 0 END AS personal FROM o""",
        "select_authors": """SELECT DISTINCT user_id FROM events
            JOIN labels ON doc_id = event_id % (SELECT count(*) FROM documents)
            WHERE toxic = 1""",
        "embed_tfidf": f"WITH {_DECORATED}, {_TFIDF} SELECT id, bucket, round(w, 6) + 0.0 AS weight FROM tw",
        "score_texts": _score_texts(),
        "predicate_scan": """SELECT event_id, user_id, event_type, value FROM events
            WHERE event_type = 'purchase' AND value > 10""",
        "append_sink": "SELECT event_id, user_id, event_type, value FROM events",
        "labelled_csv": """SELECT quality AS label, count(*) AS posts,
            CAST(sum(length(text)) AS BIGINT) AS characters
            FROM labels JOIN documents USING (doc_id) GROUP BY quality""",
        "timeline_to_intervals": f"""WITH RECURSIVE {_POSTS}, {chain},
            mp AS (SELECT {_contraction_map()} AS m),
            full_forms AS (SELECT clean.* REPLACE ({_expanded('prep')} AS prep) FROM clean, mp),
            {_ENTRY.format(source='full_forms', column='prep')},
            {_periods('entered', 25)}, {_INTERVALS} SELECT * FROM iv""",
        "stream_ingest": _STREAMED,
        "stream_ingest_horizon": _STREAMED,
        "stream_first_copies": _STREAMED,
        "rejected_messages": """SELECT reason, count(*) AS count
            FROM events, (SELECT unnest(['malformed', 'no time']) AS reason)
            WHERE event_type = 'error' GROUP BY reason""",
    }
