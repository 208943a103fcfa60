"""SQL twins of the query catalog, for DuckDB."""

from __future__ import annotations

from oracle.base import (
    corpus_cte, decoded_ctes, feature_ctes, flag_cte, framework_case, match_ctes, quote,
    rounded, stripped_ctes, with_clause,
)
from vigilrow.functions import patterns as P
from vigilrow.functions.columns import FEATURES, NGRAM_SUFFIXES, REAL_VALUED
from vigilrow.operators.gates import CODE_MARKERS
from vigilrow.operators.scoring import VOCABULARY
from vigilrow.operators.models import Grid
from vigilrow.plans.catalog import FEATURE_GROUPS, GAIN_CUTS, KKT_C, KKT_L1, RULE_SPLITS, RULE_TREES

LONG = "long_enough AS (SELECT * FROM corpus WHERE length(code) >= 20)"
PAGES = "pages_in AS (SELECT page_id AS file_id, url AS path, html AS code FROM pages)"


def over_features(select: str, *more: str) -> str:
    return with_clause(corpus_cte(), *feature_ctes(), *more) + select


def over_decoded(select: str) -> str:
    return with_clause(corpus_cte(), LONG, *decoded_ctes("long_enough"), *match_ctes("decoded")) + select


def over_flags(select: str) -> str:
    return with_clause(corpus_cte(), LONG, *decoded_ctes("long_enough"), flag_cte("decoded")) + select


SIGNATURE_NAMES = [s.column for s in P.SIGNATURES]

# --- n-gram text views -------------------------------------------------------

RUN64 = quote(r"[A-Za-z0-9+/]{200,}={0,2}")


def training_ctes(source: str) -> list[str]:
    """The training view; long base64 runs are cut out and labelled by length."""
    return [
        f"""uncommented AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(code,
      '(?s)<!--.*?-->', ' ', 'g'), '(?s)<%--.*?--%>', ' ', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g'),
      '//[^\\n]*', ' ', 'g') AS t1 FROM {source})""",
        f"""relabelled AS (SELECT *, array_to_string(list_transform(list_zip(string_split_regex(t1, {RUN64}),
      list_append(list_transform(regexp_extract_all(t1, {RUN64}), lambda m: CASE
        WHEN length(m) < 500 THEN ' BASE64_LEN_200_500 ' WHEN length(m) < 2000 THEN ' BASE64_LEN_500_2K '
        ELSE ' BASE64_LEN_GT2K ' END), '')), lambda z: z[1] || z[2]), '') AS t2 FROM uncommented)""",
        """trained AS (SELECT *, trim(regexp_replace(t2, '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))
      AS clean FROM relabelled)""",
    ]


def gram_ctes() -> list[str]:
    return [
        corpus_cte(),
        *training_ctes("corpus"),
        "folded AS MATERIALIZED (SELECT file_id, regexp_replace(strip_accents(lower(clean)), '\\s{2,}', ' ', 'g') "
        "AS t FROM trained)",
        "chars AS (SELECT file_id, t, length(t) AS n FROM folded)",
        """char_grams AS (SELECT file_id, substr(t, p, k) AS term FROM (
      SELECT file_id, t, n, k, unnest(range(1, n - k + 2)) AS p FROM chars, (VALUES (3), (4), (5), (6)) s(k)))""",
        "char_tf AS (SELECT file_id, term, count(*) AS tf FROM char_grams GROUP BY ALL)",
        "words AS (SELECT file_id, regexp_extract_all(t, '[\\p{L}\\p{N}_]+') AS w FROM folded)",
        """word_grams AS (SELECT file_id, array_to_string(w[p:p + k - 1], ' ') AS term FROM (
      SELECT file_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM words, (VALUES (1), (2), (3)) s(k)))""",
        "word_tf AS (SELECT file_id, term, count(*) AS tf FROM word_grams GROUP BY ALL)",
        "n_files AS (SELECT count(*) AS n FROM corpus)",
        *[
            f"""{b}_vocab AS MATERIALIZED (SELECT term, files, uses, ln((1 + n) / (1 + files)::DOUBLE) + 1 AS idf FROM (
      SELECT term, count(*) AS files, sum(tf)::BIGINT AS uses FROM {b}_tf GROUP BY term), n_files
      WHERE files >= {least} AND files <= n * {share}::DOUBLE ORDER BY uses DESC, term LIMIT {limit})"""
            for b, least, share, limit in (("char", 2, 0.9, 15000), ("word", 3, 0.85, 8000))
        ],
        *[
            f"""{b}_raw AS (SELECT file_id, term, (1 + ln(tf)) * idf AS raw FROM {b}_tf JOIN {b}_vocab USING (term))"""
            for b in ("char", "word")
        ],
        *[
            f"""{b}_weights AS (SELECT file_id, term,
      raw / sqrt(sum(raw * raw) OVER (PARTITION BY file_id)) AS value FROM {b}_raw)"""
            for b in ("char", "word")
        ],
    ]


def over_grams(select: str) -> str:
    return with_clause(*gram_ctes()) + select


# --- gates and judging -------------------------------------------------------

SCAN_EXT = (
    "'.php', '.asp', '.aspx', '.jsp', '.jspx', '.py', '.js', '.txt', '.cs', '.config', '.inc', '.phtml', "
    "'.cgi', '.pl', '.ascx', '.asax', '.ashx', '.asmx', ''"
)


def gate_ctes(scan_all: bool) -> list[str]:
    if not scan_all:
        return [
            f"""gated AS (SELECT *, CASE WHEN ext NOT IN ({SCAN_EXT}) THEN 'skipped_by_ext'
      WHEN length(code) < 20 THEN 'skipped' END AS gate FROM corpus)"""
        ]
    marked = " OR ".join(f"contains(head, {quote(m)})" for m in CODE_MARKERS)
    return [
        """probed AS (SELECT *, list_transform(regexp_extract_all(hex(encode(code)), '..'),
      lambda h: chr(CAST('0x' || h AS INTEGER))) AS head_chars FROM corpus)""",
        f"""probed2 AS (SELECT *, array_to_string(head_chars, '') AS head,
      len(list_filter(head_chars, lambda c: (c >= ' ' AND c <= '~') OR c IN (chr(9), chr(10), chr(13))))
        / len(head_chars)::DOUBLE AS plain FROM probed)""",
        f"""gated AS (SELECT *, CASE
      WHEN ext IN ('.txt', '.config', '.log', '.dat', '.bak', '')
        AND NOT (len(head_chars) > 0 AND ({marked} OR plain > 0.7)) THEN 'skipped_no_code'
      WHEN length(code) < 20 THEN 'skipped' END AS gate FROM probed2)""",
    ]


def positive(names: str, how: str = " OR ") -> str:
    return "(" + how.join(f"{n} > 0" for n in names.split()) + ")"


ANY_GENERIC = "behavior_reverse_shell behavior_rawbody_backdoor"
ANY_PHP = (
    "behavior_input_decode_exec behavior_password_backdoor behavior_upload_chmod "
    "behavior_cookie_hash_gate_dyn_call has_superglobal_var_call behavior_arbitrary_upload_path "
    "behavior_sqlmap_uploader behavior_filterinput_exec behavior_file_manager " + ANY_GENERIC
)
ANY_NET = (
    "behavior_aspx_process_shell behavior_aspx_file_manager behavior_aspx_privilege_pipe "
    "behavior_jscript_webshell behavior_dotnet_memory_shell " + ANY_GENERIC
)
ANY_JSP = "behavior_jsp_memory_shell behavior_jsp_request_exec behavior_jsp_http_tunneling " + ANY_GENERIC
FIRM_PHP = (
    "behavior_input_decode_exec behavior_password_backdoor behavior_cookie_hash_gate_dyn_call has_superglobal_var_call"
)
FIRM_NET = (
    "behavior_aspx_process_shell behavior_aspx_privilege_pipe behavior_jscript_webshell behavior_dotnet_memory_shell"
)
FIRM_JSP = (
    "behavior_jsp_memory_shell behavior_jsp_request_exec behavior_jsp_hardcoded_backdoor behavior_jsp_http_backdoor"
)


def family(java: str, net: str, php: str) -> str:
    return (
        f"CASE WHEN ext IN ('.jsp', '.jspx', '.java') THEN {positive(java)} "
        f"WHEN ext IN ('.aspx', '.ascx', '.asax', '.ashx') THEN {positive(net)} ELSE {positive(php)} END"
    )


STRONG = positive(
    "behavior_cookie_hash_gate_dyn_call behavior_aspx_process_shell behavior_aspx_privilege_pipe "
    "behavior_jsp_memory_shell behavior_jsp_request_exec behavior_jsp_hardcoded_backdoor "
    "behavior_jsp_http_backdoor behavior_jscript_webshell behavior_dotnet_memory_shell "
    "has_superglobal_var_call behavior_input_decode_exec behavior_password_backdoor"
)
MEDIUM = (
    "("
    + positive(
        "has_assign_input_then_call behavior_upload_chmod behavior_aspx_file_manager "
        "behavior_jsp_http_tunneling behavior_file_manager"
    )
    + " OR (has_exec_function > 0 AND has_input_access > 0) OR (has_decode_function > 0 AND has_input_access > 0))"
)
WORDS = " + ".join(f"contains(lower(code), {quote(w)})::INT" for w in VOCABULARY)


def walk_ctes(values: str, source: str) -> list[str]:
    """``walked``: file_id and probability by the rule-made ensemble; ``values`` is the list of the features' values."""
    feature = f"(tree * 31 + node * 17) % {len(FEATURES)} + 1"
    return [
        f"matrix AS MATERIALIZED (SELECT file_id, [{values}] AS x FROM {source})",
        f"""walk AS (
  SELECT file_id, x, tree::INT AS tree, 0 AS node FROM matrix, range({RULE_TREES}) t(tree)
  UNION ALL
  SELECT file_id, x, tree, CASE WHEN x[{feature}] <= (tree * 7 + node * 5) % 16 / 4.0::DOUBLE THEN 2 * node + 1 ELSE 2 * node + 2 END
  FROM walk WHERE node < {RULE_SPLITS})""",
        f"""walked AS (SELECT file_id, 1 / (1 + exp(-sum(((tree * 13 + node * 11) % 21 - 10) / 40.0::DOUBLE))) AS prob_tree
  FROM walk WHERE node >= {RULE_SPLITS} GROUP BY file_id)""",
    ]


STAND_IN = """(file_id * 37 % 1000 + 0.37::DOUBLE) / 1000::DOUBLE AS prob_tree,
      (file_id * 53 % 1000 + 0.37::DOUBLE) / 1000::DOUBLE AS prob_ngram,
      0.75::DOUBLE * prob_tree + 0.25::DOUBLE * prob_ngram AS prob,"""


def judge_ctes(
    mode: str = "hunting", scan_all: bool = False, named: bool = False, scores: str = STAND_IN, limit: str = "", before: tuple = (), source: str = "features"
) -> list[str]:
    t = limit or ("0.55::DOUBLE" if mode == "hunting" else "0.8597691138350111::DOUBLE")

    def at(factor: float) -> str:
        return f"prob >= {t} * {factor}::DOUBLE"

    gain = "+ CASE WHEN {0} > 0 THEN {1}::DOUBLE ELSE 0.0::DOUBLE END"
    gains = " ".join(
        gain.format(name, value)
        for name, value in (
            ("behavior_cookie_hash_gate_dyn_call", 0.20), ("has_superglobal_var_call", 0.15),
            ("behavior_password_backdoor", 0.15), ("behavior_input_decode_exec", 0.12),
            ("behavior_aspx_process_shell", 0.25), ("behavior_jscript_webshell", 0.35),
            ("behavior_dotnet_memory_shell", 0.35), ("behavior_aspx_privilege_pipe", 0.30),
            ("behavior_aspx_file_manager", 0.18), ("behavior_jsp_memory_shell", 0.35),
            ("behavior_jsp_request_exec", 0.28), ("behavior_jsp_http_tunneling", 0.25),
            ("behavior_jsp_hardcoded_backdoor", 0.40), ("behavior_jsp_http_backdoor", 0.35),
        )
    )
    by_name = f"WHEN detected_framework <> '' THEN NOT ({family(ANY_JSP, ANY_NET, ANY_PHP)})" if named else ""
    ratio_cut = (
        "CASE WHEN ext IN ('.aspx', '.ascx', '.asax', '.ashx', '.jsp', '.jspx', '.java') "
        "THEN CASE WHEN string_literal_ratio > 0.85::DOUBLE THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END "
        "ELSE CASE WHEN string_literal_ratio > 0.7::DOUBLE THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END END"
    )
    unless_harmless = "CASE WHEN threat < 0.2::DOUBLE THEN 'CLEAN' ELSE 'SUSPICIOUS' END"
    downgrade = (
        "CASE WHEN first_verdict = 'WEBSHELL' AND (confidence < 0.35::DOUBLE OR is_framework OR blob > 0.5::DOUBLE) "
        "THEN 'SUSPICIOUS' ELSE first_verdict END"
        if mode == "hunting"
        else "first_verdict"
    )
    return [
        *gate_ctes(scan_all),
        "passing AS (SELECT file_id, path, ext, size, code FROM gated WHERE gate IS NULL)",
        *feature_ctes("passing"),
        *before,
        f"""seen AS (SELECT *, benign_data_blob_score AS blob, overall_threat_score AS threat,
      {scores}
      {WORDS} AS vocabulary_hits,
      {family(ANY_JSP, ANY_NET, ANY_PHP)} AS any_behaviour,
      {family(FIRM_JSP, FIRM_NET, FIRM_PHP)} AS firm,
      {STRONG} AS strong_evidence, {MEDIUM} AS medium_evidence,
      (has_exec_function > 0 AND NOT (ext IN ('.aspx', '.ascx', '.asax') AND aspx_databinding_eval_count > 0
        AND aspx_code_eval_count = 0)) AS runs
      FROM {source})""",
        f"""framed AS (SELECT *, CASE {by_name}
      WHEN size > 100000 THEN NOT firm
      WHEN entropy > 4.5::DOUBLE AND NOT (runs AND has_input_access > 0) THEN true
      WHEN string_literal_ratio > 0.75::DOUBLE THEN NOT any_behaviour
      WHEN blob > 0.8::DOUBLE THEN true
      WHEN vocabulary_hits >= 3 THEN true ELSE false END AS is_framework FROM seen)""",
        f"""sure AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE
      + CASE WHEN is_framework THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END {gains}
      + CASE WHEN blob > 0.4::DOUBLE THEN -0.25::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN blob > 0.7::DOUBLE THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END
      + {ratio_cut}
      + CASE WHEN threat < 0.2::DOUBLE THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END)) AS confidence FROM framed)""",
        f"""decided AS (SELECT *, CASE
      WHEN behavior_jscript_webshell > 0 OR behavior_dotnet_memory_shell > 0 THEN
        CASE WHEN {at(0.4)} THEN 'WEBSHELL' WHEN {at(0.2)} THEN 'SUSPICIOUS'
             WHEN confidence > 0.3::DOUBLE THEN 'SUSPICIOUS' ELSE 'CLEAN' END
      WHEN is_framework AND strong_evidence THEN
        CASE WHEN {at(1.2)} THEN 'WEBSHELL' WHEN {at(0.8)} THEN 'SUSPICIOUS' ELSE 'CLEAN' END
      WHEN is_framework AND medium_evidence THEN CASE WHEN {at(1.5)} THEN 'SUSPICIOUS' ELSE 'CLEAN' END
      WHEN is_framework THEN CASE WHEN {at(2.5)} THEN {unless_harmless} ELSE 'CLEAN' END
      WHEN blob > 0.6::DOUBLE AND threat < 0.3::DOUBLE THEN 'CLEAN'
      WHEN ext IN ('.js', '.css') THEN
        CASE WHEN strong_evidence AND {at(2.0)} THEN 'WEBSHELL'
             WHEN strong_evidence AND {at(1.5)} THEN 'SUSPICIOUS'
             WHEN medium_evidence AND {at(2.2)} THEN 'SUSPICIOUS'
             WHEN {at(2.5)} THEN {unless_harmless} ELSE 'CLEAN' END
      WHEN strong_evidence OR medium_evidence THEN
        CASE WHEN {at(0.6)} THEN 'WEBSHELL' WHEN {at(0.4)} THEN 'SUSPICIOUS' ELSE 'CLEAN' END
      WHEN {at(1.8)} THEN CASE WHEN blob > 0.5::DOUBLE OR threat < 0.3::DOUBLE THEN 'SUSPICIOUS' ELSE 'WEBSHELL' END
      WHEN {at(1.3)} THEN CASE WHEN threat > 0.3::DOUBLE THEN 'WEBSHELL' WHEN blob < 0.4::DOUBLE THEN 'SUSPICIOUS'
                               ELSE 'CLEAN' END
      WHEN {at(0.35)} THEN CASE WHEN threat > 0.35::DOUBLE AND confidence > 0.4::DOUBLE THEN 'SUSPICIOUS'
                                ELSE 'CLEAN' END
      ELSE 'CLEAN' END AS first_verdict FROM sure)""",
        f"verdicts AS (SELECT *, {downgrade} AS verdict FROM decided)",
        """statuses AS (SELECT gate AS status FROM gated WHERE gate IS NOT NULL
      UNION ALL SELECT verdict FROM verdicts)""",
        """results AS (SELECT file_id, path AS file, ext AS extension, round(prob, 4) AS probability,
      round(prob_tree, 4) AS probability_lgbm, round(prob_ngram, 4) AS probability_ngram,
      round(confidence, 4) AS confidence, verdict, round(blob, 4) AS blob_score, round(threat, 4) AS threat_score,
      is_framework::INTEGER AS is_framework, detected_framework FROM verdicts)""",
    ]


def over_verdicts(select: str, mode: str = "hunting", scan_all: bool = False, named: bool = False) -> str:
    return with_clause(corpus_cte(), *judge_ctes(mode, scan_all, named)) + select


EXPORTS = [
    """named AS (SELECT verdict, file, regexp_extract(file, '([^/]*)$', 1) AS basename, md5(file) AS digest
      FROM results)""",
    """split AS (SELECT *, regexp_extract(basename, '[^.].*(\\.[^.]*)$', 1) AS suffix,
      left(basename, length(basename) - length(suffix)) AS stem,
      row_number() OVER (PARTITION BY verdict, basename ORDER BY digest, file) - 1 AS copy FROM named)""",
    """held AS (SELECT DISTINCT verdict, regexp_extract(stem, '^(.*)_[1-9][0-9]*$', 1) || suffix AS basename,
      regexp_extract(stem, '^.*_([1-9][0-9]*)$', 1)::BIGINT AS number FROM split
      WHERE regexp_matches(stem, '^.*_[1-9][0-9]*$'))""",
    # Candidate numbers: as many as there are copies and held numbers together.
    """room AS (SELECT verdict, basename, count(*) + (SELECT count(*) FROM held h
      WHERE h.verdict = s.verdict AND h.basename = s.basename) AS most FROM split s GROUP BY verdict, basename)""",
    """free AS (SELECT verdict, basename, number, row_number() OVER (PARTITION BY verdict, basename ORDER BY number)
      AS copy FROM (SELECT verdict, basename, unnest(range(1, most + 1)) AS number FROM room)
      ANTI JOIN held USING (verdict, basename, number))""",
]

# --- evaluation --------------------------------------------------------------

SCORES = """scores AS (SELECT (event_type = 'purchase')::INT AS label,
      least(1.0::DOUBLE, (value + (event_type = 'purchase')::INT * 40) / 500::DOUBLE) AS score FROM events)"""
TIED = """scores AS (SELECT toxic::INT AS label, (doc_id * 37 % 61 + 39 * toxic) / 100::DOUBLE AS score FROM labels)"""
RUNS = [
    "score_groups AS (SELECT score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM scores GROUP BY score)",
    """score_runs AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp
      FROM score_groups)""",
    """pr AS (SELECT score AS threshold, tp / (tp + fp)::DOUBLE AS precision,
      tp / (SELECT sum(label) FROM scores)::DOUBLE AS recall FROM score_runs)""",
]
TREE_PICK = """tree_pick AS (SELECT
      coalesce((SELECT threshold FROM pr WHERE precision >= 0.99::DOUBLE ORDER BY recall DESC, threshold LIMIT 1),
        0.9::DOUBLE) AS blocking_threshold,
      coalesce((SELECT threshold FROM pr WHERE recall >= 0.96::DOUBLE ORDER BY precision DESC, threshold LIMIT 1),
        0.5::DOUBLE) AS hunting_threshold)"""
NGRAM_PICK = """ngram_pick AS (SELECT
      (SELECT threshold FROM pr ORDER BY 2 * (precision * recall) / (precision + recall + 1e-10::DOUBLE) DESC, threshold
        LIMIT 1) AS threshold_f1,
      coalesce((SELECT min(threshold) FROM pr WHERE precision >= 0.95::DOUBLE), 0.9::DOUBLE) AS threshold_blocking,
      coalesce((SELECT max(threshold) FROM pr WHERE recall >= 0.95::DOUBLE), 0.3::DOUBLE) AS threshold_hunting)"""


def auc_of(scores: str, name: str = "auc") -> str:
    """Wins of positives over negatives, ties one half, counted pair group by pair group."""
    return f"""(SELECT sum(n.n * p.n * CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score
      THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / (sum(n.n * p.n))::DOUBLE FROM
      (SELECT score, count(*) AS n FROM {scores} WHERE label = 0 GROUP BY score) n,
      (SELECT score, count(*) AS n FROM {scores} WHERE label = 1 GROUP BY score) p) AS {name}"""


def grid_ctes(first: str, last: str) -> list[str]:
    return [
        f"ends AS (SELECT {first} AS a, {last} AS b)",
        """grid AS (SELECT k::INTEGER AS k, CASE WHEN k = 99 THEN b ELSE a + k * ((b - a) / 99) END AS threshold
      FROM ends, range(0, 100) r(k))""",
        """grid_rates AS (SELECT k, threshold,
      (SELECT avg((score >= threshold)::INT) FROM scores WHERE label = 0) AS fp_rate,
      (SELECT avg((score < threshold)::INT) FROM scores WHERE label = 1) AS fn_rate FROM grid)""",
    ]


REPORT_SQL = """
SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT CASE WHEN class = 1 THEN 'bad' ELSE 'clean' END AS row, precision, recall, f1, support FROM per_class
  UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT avg((label = guess)::INT) AS a, count(*) AS s FROM marks)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM per_class
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support)::BIGINT FROM per_class)"""
REPORT_CTES = [
    "marks AS (SELECT label, (score >= 0.5)::INT AS guess FROM scores)",
    """per_class AS (SELECT class, right_ / guessed::DOUBLE AS precision, right_ / support::DOUBLE AS recall,
      2.0 * right_ / (guessed + support)::DOUBLE AS f1, support FROM (
      SELECT class, (SELECT count(*) FROM marks WHERE label = class AND guess = class) AS right_,
        (SELECT count(*) FROM marks WHERE guess = class) AS guessed,
        (SELECT count(*) FROM marks WHERE label = class) AS support FROM (VALUES (0), (1)) c(class)))""",
]

# --- training data -----------------------------------------------------------

SIGNS = f"signs AS (SELECT file_id, ({STRONG} OR {MEDIUM})::INT AS label FROM features)"


def split_ctes(source: str, prefix: str, share: float, seed: int) -> list[str]:
    return [
        f"""{prefix}_ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(file_id || ':{seed}'),
      file_id) AS r, count(*) OVER (PARTITION BY label) AS n_label, count(*) OVER () AS n FROM {source})""",
        f"""{prefix}_labels AS (SELECT label, floor(want * n_label / n) AS base,
      round(want * n_label / n::DOUBLE - floor(want * n_label / n), 9) AS rest, want FROM (
      SELECT DISTINCT label, n_label, n, ceil(n * {share}::DOUBLE) AS want FROM {prefix}_ranked))""",
        f"""{prefix}_quota AS (SELECT label, base + (row_number() OVER (ORDER BY rest DESC, label)
      <= (max(want) OVER () - sum(base) OVER ()))::INT AS quota FROM {prefix}_labels)""",
        f"""{prefix}_split AS (SELECT file_id, label, CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS part
      FROM {prefix}_ranked JOIN {prefix}_quota USING (label))""",
    ]


WEIGHT = """CASE WHEN file_id % 3 <> 1 THEN 1.0::DOUBLE
  WHEN behavior_input_decode_exec > 0 OR behavior_password_backdoor > 0 OR behavior_jscript_webshell > 0
    OR behavior_dotnet_memory_shell > 0 OR behavior_aspx_process_shell > 0 OR behavior_jsp_memory_shell > 0
    OR behavior_jsp_hardcoded_backdoor > 0 OR (behavior_file_manager > 0 AND behavior_password_backdoor > 0)
  THEN 3.0::DOUBLE ELSE 1.5::DOUBLE END"""

BOOST_CRIT = (
    "behavior_input_decode_exec behavior_password_backdoor behavior_upload_chmod has_assign_input_then_call "
    "behavior_aspx_process_shell behavior_aspx_privilege_pipe behavior_aspx_file_manager behavior_jsp_memory_shell "
    "behavior_jsp_request_exec behavior_jsp_hardcoded_backdoor behavior_jscript_webshell behavior_dotnet_memory_shell"
).split()
BOOST_STRONG = (
    "behavior_cookie_hash_gate_dyn_call behavior_aspx_tunneling behavior_jsp_http_tunneling "
    "behavior_jsp_http_backdoor has_superglobal_var_call behavior_filterinput_exec behavior_arbitrary_upload_path "
    "behavior_file_manager"
).split()
BOOST_EXTRA = ["behavior_cookie_exec", "behavior_rawbody_backdoor"]
BOOST_INTENT = (
    "intent_webshell_score intent_backdoor_score intent_c2_score intent_privilege_escalation overall_threat_score"
).split()
FACTORS = {
    "serve": {**dict.fromkeys(BOOST_CRIT, 1.8), **dict.fromkeys(BOOST_STRONG, 1.4)},
    "train": {
        **dict.fromkeys(BOOST_CRIT, 3.5), **dict.fromkeys(BOOST_STRONG + BOOST_EXTRA, 2.5),
        **dict.fromkeys(BOOST_INTENT, 2.0),
    },
}


def boosted_sql(profile: str) -> str:
    cols = ", ".join(f"round({c} * {f}::DOUBLE, 6) AS {c}" for c, f in sorted(FACTORS[profile].items()))
    return over_features(f"SELECT file_id, {cols} FROM features")


def scaler_sql(columns: list[str], source: str, factors: dict[str, float]) -> str:
    def one(c: str) -> str:
        v = f"({c} * {factors[c]}::DOUBLE)" if c in factors else f"{c}::DOUBLE"
        q = lambda s: f"quantile_cont({v}, {s})"
        return (
            f"SELECT '{c}' AS feature, round({q(0.5)}, 6) AS median, round(CASE WHEN {q(0.75)} = {q(0.25)} THEN 1.0 "
            f"ELSE {q(0.75)} - {q(0.25)} END, 6) AS scale FROM {source}"
        )

    return "\nUNION ALL ".join(one(c) for c in columns)


GRID = Grid()
#: The stored forms of the documents: ``wide`` is what their bytes give if each is one character, in hex.
LEAST_CHARS = 20
ENCODED = r"""
WITH stored AS (
  SELECT doc_id AS file_id, doc_id % 6 AS kind, text, string_split(text, '') AS letters,
    regexp_replace(text, '[^\x{00}-\x{ff}]', '?', 'g') AS narrow FROM documents),
raw AS (
  SELECT *, CASE kind WHEN 0 THEN strlen(text) WHEN 1 THEN 2 * length(text) + 2 WHEN 2 THEN 2 * length(text) + 2
      WHEN 3 THEN length(narrow) + 2 WHEN 4 THEN length(narrow) + 4 ELSE strlen(text) + 2 END AS n,
    list_transform(string_split(CASE WHEN kind IN (3, 4) THEN narrow ELSE text END, ''), lambda c: hex(c)) AS codes FROM stored),
latin AS (
  SELECT *, n + (kind > 2 AND n % 2 = 0)::INT AS octets,
    CASE kind WHEN 0 THEN '' WHEN 1 THEN 'C3BFC3BE' WHEN 2 THEN 'C3BEC3BF' WHEN 3 THEN 'C3A920' WHEN 4 THEN 'C396C390C38EC384' ELSE 'C38328' END
    || array_to_string(list_transform(codes, lambda c: CASE
         WHEN kind IN (0, 5) AND length(c) = 4 THEN hex(chr(('0x' || c[:2])::INT)) || hex(chr(('0x' || c[3:])::INT))
         WHEN kind = 1 THEN c || '00' WHEN kind = 2 THEN '00' || c ELSE c END), '')
    || CASE WHEN kind > 2 AND n % 2 = 0 THEN 'C3A9' ELSE '' END AS wide FROM raw)"""


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    corpus_only = lambda select, *more: with_clause(corpus_cte(), *more) + select
    text = "length({0}) AS chars, md5({0}) AS {1}"

    # sources
    sql["source_files"] = corpus_only("SELECT file_id, path, ext, size, md5(code) AS code_md5 FROM corpus")
    sql["source_from_table"] = """
SELECT page_id AS file_id, url AS path, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1),
  '(?s)[^.].*(\\.[^.]*)$', 1)) AS ext, strlen(html)::BIGINT AS size, length(html)::INTEGER AS chars FROM pages"""
    sql["source_labelled"] = corpus_only("""
SELECT toxic::INTEGER AS label, ext, count(*) AS files, sum(size)::BIGINT AS bytes
FROM corpus JOIN labels ON file_id = doc_id GROUP BY ALL""")

    # text
    sql["text_decode_escapes"] = corpus_only(
        f"SELECT file_id, {text.format('norm', 'norm_md5')} FROM decoded", *decoded_ctes()
    )
    stripped = f"SELECT file_id, {text.format('stripped', 'stripped_md5')}, " \
        "round(string_literal_ratio, 6) AS string_literal_ratio FROM plain"
    sql["text_strip_strings_comments"] = corpus_only(stripped, *stripped_ctes("corpus"))
    sql["text_strip_pages"] = with_clause(PAGES, *stripped_ctes("pages_in")) + stripped
    trained = f"SELECT file_id, {text.format('clean', 'clean_md5')} FROM trained"
    sql["text_training_view"] = corpus_only(trained, *training_ctes("corpus"))
    sql["text_training_view_pages"] = with_clause(PAGES, *training_ctes("pages_in")) + trained
    sql["text_scoring_view"] = corpus_only(
        f"SELECT file_id, {text.format('code', 'clean_md5')} FROM corpus"
    )
    sql["text_literal_counts"] = corpus_only("""
SELECT file_id, len(regexp_extract_all(code, '=>')) AS arrows, len(regexp_extract_all(lower(code), '<path')) AS paths,
  len(regexp_extract_all(lower(code), 'd="')) AS outlines, length(code) AS chars FROM corpus""")

    # decoding
    sql["source_decode_scan"] = ENCODED + """
SELECT file_id, md5(unhex(CASE WHEN kind < 3 THEN hex(text) ELSE wide END)) AS code_md5,
  CASE WHEN kind < 3 THEN length(text) ELSE octets END::INTEGER AS chars,
  CASE WHEN kind = 0 THEN 'utf-8' WHEN kind < 3 THEN 'utf-16' ELSE 'latin-1' END AS encoding FROM latin"""
    # The first rung with 20 characters: UTF-8, UTF-16 by its mark, the mark taken for a character, one character a byte.
    sql["source_decode_ngrams"] = ENCODED + f"""
SELECT file_id, md5(unhex(CASE encoding WHEN 'latin-1' THEN wide WHEN 'utf-16-le' THEN shifted
    WHEN 'utf-16-be' THEN 'EFBBBF' || hex(text) ELSE hex(text) END)) AS code_md5, encoding
FROM (SELECT *,
    CASE WHEN kind = 1 THEN 'EFBBBF' || hex(text)
         ELSE hex(chr(65534)) || array_to_string(list_transform(letters, lambda c: CASE WHEN ascii(c) BETWEEN 216 AND 223 THEN '' ELSE hex(chr(ascii(c) * 256)) END), '') END AS shifted,
    CASE WHEN kind = 0 AND length(text) >= {LEAST_CHARS} THEN 'utf-8'
         WHEN kind IN (1, 2) AND length(text) >= {LEAST_CHARS} THEN 'utf-16'
         WHEN kind = 1 AND length(text) = {LEAST_CHARS - 1} THEN 'utf-16-le'
         WHEN kind = 2 AND length(text) = {LEAST_CHARS - 1} THEN
           CASE WHEN len(list_filter(letters, lambda c: ascii(c) BETWEEN 216 AND 223)) > 0 THEN 'utf-16-be' ELSE 'utf-16-le' END
         WHEN octets >= {LEAST_CHARS} THEN 'latin-1' END AS encoding FROM latin)
WHERE encoding IS NOT NULL"""

    # folders
    tree = """(SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN 'site a/' || doc_id || '.php' WHEN 1 THEN '.hidden/' || doc_id || '.JSP'
    WHEN 2 THEN '_vendor/.' || doc_id || '.aspx' WHEN 3 THEN 'deep/' || doc_id % 10 || '/x/' || doc_id || '.txt'
    WHEN 4 THEN 'odd[' || doc_id % 3 || ']%20/' || doc_id ELSE doc_id || '.tar.gz' END AS name,
  (['.php', '.jsp', '.aspx', '.txt', '', '.gz'])[doc_id % 6 + 1] AS ext,
  CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS content FROM documents)"""
    one = "name, ext, strlen(content) AS size, md5(content)"
    sql["source_folder"] = f"SELECT {one} AS content_md5 FROM {tree}"
    sql["source_folder_flat"] = f"SELECT {one} AS content_md5 FROM {tree} WHERE doc_id % 6 IN (0, 5)"
    sql["source_folder_ngrams"] = f"""
SELECT {one} AS code_md5, 'utf-8' AS encoding FROM {tree}
WHERE ext IN ({", ".join(map(quote, NGRAM_SUFFIXES))}) AND strlen(content) BETWEEN 1 AND 20000 AND length(content) >= {LEAST_CHARS}"""

    # features
    sql["features_calls"] = over_decoded("""
SELECT file_id, exec_func_count, decode_func_count, input_count, dynamic_count,
  (exec_func_count > 0)::INT AS has_exec_function, (decode_func_count > 0)::INT AS has_decode_function,
  (input_count > 0)::INT AS has_input_access, (dynamic_count > 0)::INT AS has_dynamic_exec FROM counted""")
    sql["features_distance"] = over_decoded("""
SELECT file_id, round(input_exec_distance, 6) AS input_exec_distance,
  short_input_exec_distance::INT AS short_input_exec_distance FROM counted""")
    sql["features_template_eval"] = over_decoded(
        "SELECT file_id, aspx_databinding_eval_count, aspx_code_eval_count, exec_func_count FROM counted"
    )
    for name, columns in FEATURE_GROUPS.items():
        sql[name] = over_features(f"SELECT file_id, {rounded(columns.split())} FROM features")
    flags = ", ".join(f"{c}::INT AS {c}" for c in SIGNATURE_NAMES)
    sql["features_signatures"] = over_flags(
        f"SELECT file_id, {flags}, long_base64_count, deep_array_access_count FROM flagged"
    )
    listed = ", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in SIGNATURE_NAMES)
    sql["features_signature_hits"] = over_flags(f"""
SELECT signature, ext, count(*) AS files FROM (SELECT ext, unnest([{listed}]) AS signature FROM flagged)
WHERE signature IS NOT NULL GROUP BY ALL""")
    sql["features_framework"] = corpus_only(
        f"SELECT ext, {framework_case('code')} AS detected_framework, count(*) AS files "
        "FROM long_enough GROUP BY ALL",
        LONG,
    )
    sql["features_all"] = over_features(f"SELECT file_id, {rounded(FEATURES)}, detected_framework FROM features")
    sql["features_overview"] = over_decoded(f"""
SELECT ext, {framework_case('code')} AS detected_framework, count(*) AS files,
  sum(exec_func_count)::BIGINT AS exec_func_count, sum(input_count)::BIGINT AS input_count,
  sum(decode_func_count)::BIGINT AS decode_func_count FROM counted GROUP BY ALL""")

    # matrix
    zero = {"entropy", "has_goto", "log_code_size"}
    aligned = ", ".join(
        f"0.0::DOUBLE AS {c}" if c in zero else f"round({c}::DOUBLE, 6) AS {c}" for c in FEATURES
    )
    sql["matrix_aligned"] = over_features(f"SELECT file_id, {aligned} FROM features")
    sql["matrix_clean_numbers"] = """
SELECT event_id, CASE WHEN event_type IN ('error', 'view', 'signup') THEN 0.0::DOUBLE ELSE value END AS value
FROM events"""
    sql["matrix_boost_serve"] = boosted_sql("serve")
    sql["matrix_boost_train"] = boosted_sql("train")
    sql["matrix_scaler_fit"] = over_features(scaler_sql(list(FEATURES), "features", FACTORS["train"]))
    dims = [f"e{i}" for i in range(64)]
    unpacked = ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(64))
    sql["matrix_scaler_fit_embeddings"] = (
        with_clause(f"wide AS MATERIALIZED (SELECT {unpacked} FROM embeddings)") + scaler_sql(dims, "wide", {})
    )
    real = sorted(REAL_VALUED)
    quart = ", ".join(
        f"quantile_cont({c}, 0.5) AS {c}_m, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1.0 "
        f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS {c}_s"
        for c in real
    )
    sql["matrix_scaled"] = over_features(
        "SELECT file_id, " + ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) AS {c}" for c in real) + " FROM features, fitted",
        f"fitted AS (SELECT {quart} FROM features)",
    )

    # gates and judging
    gate = "SELECT file_id, ext, coalesce(gate, 'scan') AS gate FROM gated"
    sql["gate_by_suffix"] = corpus_only(gate, *gate_ctes(False))
    sql["gate_by_probe"] = corpus_only(gate, *gate_ctes(True))
    sql["judge_behaviours"] = over_verdicts(
        "SELECT file_id, any_behaviour::INT AS any_behaviour, firm::INT AS firm FROM verdicts", scan_all=True
    )
    both = judge_ctes("hunting", True, True)
    renamed = [c.replace("framed AS (", "framed_named AS (") for c in both if c.startswith("framed AS")]
    sql["judge_framework"] = (
        with_clause(corpus_cte(), *judge_ctes("hunting", True, False), *renamed)
        + "SELECT f.file_id, f.vocabulary_hits, f.is_framework::INT AS is_framework, "
        "n.is_framework::INT AS is_framework_by_name FROM framed f JOIN framed_named n USING (file_id)"
    )
    sql["judge_confidence"] = over_verdicts("""
SELECT file_id, round(prob, 6) AS prob, round(confidence, 6) AS confidence, strong_evidence::INT AS strong_evidence,
  medium_evidence::INT AS medium_evidence FROM verdicts""")
    sql["scan_hunting"] = over_verdicts("SELECT * FROM results")
    sql["scan_blocking"] = over_verdicts("SELECT * FROM results", "blocking")
    sql["scan_hunting_all_files"] = over_verdicts("SELECT * FROM results", "hunting", True)
    sql["scan_blocking_all_files"] = over_verdicts("SELECT * FROM results", "blocking", True)
    sql["scan_hunting_named_frameworks"] = over_verdicts("SELECT * FROM results", "hunting", True, True)

    served = ", ".join(
        f"({c} * {FACTORS['serve'].get(c, 1.0)}::DOUBLE - {k % 3 / 4}::DOUBLE) / {1 + k % 4 / 2}::DOUBLE" for k, c in enumerate(FEATURES)
    )
    sql["scan_bundle"] = "WITH RECURSIVE " + ",\n".join([corpus_cte(), *judge_ctes(
        scores="prob_tree, 0.0::DOUBLE AS prob_ngram, prob_tree AS prob,", limit="least(0.5::DOUBLE * 1.5::DOUBLE, 0.55::DOUBLE)",
        before=tuple(walk_ctes(served, "features")), source="features JOIN walked USING (file_id)",
    )]) + "\nSELECT * FROM results"
    plain = ", ".join(f"{c}::DOUBLE" for c in FEATURES)
    sql["score_trees"] = "WITH RECURSIVE " + ",\n".join([corpus_cte(), *feature_ctes(), *walk_ctes(plain, "features")]) + """
SELECT file_id, round(prob_tree, 6) AS prob_tree FROM walked"""

    sql["sink_report"] = over_verdicts("SELECT file, extension, verdict, probability, confidence, threat_score FROM results")
    sql["sink_report_summary"] = over_verdicts(
        "SELECT 'hunting' AS mode, 0.55::DOUBLE AS threshold, status, count(*) AS files FROM statuses GROUP BY status"
    )

    # reports
    counts = "SELECT status, count(*) AS files FROM statuses GROUP BY status"
    sql["report_status_counts"] = over_verdicts(counts)
    sql["report_status_counts_all_files"] = over_verdicts(counts, scan_all=True)
    sql["report_coverage"] = over_verdicts("""
SELECT webshells, detections, scanned, skipped, skipped_by_ext, skipped_no_code, errors, files,
  round(100.0::DOUBLE * detections / scanned, 6) AS detection_rate,
  round(100.0::DOUBLE * webshells / scanned, 6) AS webshell_rate, round(100.0::DOUBLE * scanned / files, 6) AS coverage
FROM (SELECT count(*) FILTER (status = 'WEBSHELL') AS webshells,
  count(*) FILTER (status IN ('WEBSHELL', 'SUSPICIOUS')) AS detections,
  count(*) FILTER (status IN ('WEBSHELL', 'SUSPICIOUS', 'CLEAN')) AS scanned,
  count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'skipped_by_ext') AS skipped_by_ext,
  count(*) FILTER (status = 'skipped_no_code') AS skipped_no_code, count(*) FILTER (status = 'errors') AS errors,
  count(*) AS files FROM statuses)""")
    sql["report_top_results"] = over_verdicts(
        "SELECT file, probability, confidence, verdict FROM results ORDER BY probability DESC, file LIMIT 50"
    )
    sql["report_export_names"] = with_clause(corpus_cte(), *judge_ctes(), *EXPORTS) + """
SELECT s.verdict, s.file, CASE WHEN s.copy = 0 THEN s.basename ELSE s.stem || '_' || f.number || s.suffix END
  AS export_name FROM split s LEFT JOIN free f USING (verdict, basename, copy)"""
    active = "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER ({c} <> 0) AS files, round(sum({c})::DOUBLE, 6) AS total FROM features"
        for c in FEATURES
    )
    sql["report_feature_activity"] = over_features(active)
    sql["report_feature_families"] = over_features(f"""
SELECT count(*) AS features, count(*) FILTER (contains(feature, 'aspx')) AS aspx_features,
  count(*) FILTER (contains(feature, 'behavior_')) AS behavior_features,
  count(*) FILTER (contains(feature, 'intent_')) AS intent_features FROM ({active}) WHERE files > 0""")

    # evaluation
    auc = "SELECT round(auc, 6) AS auc, positives, negatives FROM (SELECT " + auc_of("scores") + """,
  (SELECT count(*) FROM scores WHERE label = 1) AS positives, (SELECT count(*) FROM scores WHERE label = 0) AS negatives)"""
    sql["eval_roc_auc"] = with_clause(SCORES) + auc
    sql["eval_roc_auc_ties"] = with_clause(TIED) + auc
    curve = """SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM (SELECT * FROM pr UNION ALL SELECT NULL, 1.0, 0.0)"""
    sql["eval_pr_curve"] = with_clause(SCORES, *RUNS) + curve
    sql["eval_pr_curve_ties"] = with_clause(TIED, *RUNS) + curve
    tree = """SELECT round(blocking_threshold, 6) AS blocking_threshold, round(hunting_threshold, 6) AS hunting_threshold
FROM tree_pick"""
    sql["eval_tree_thresholds"] = with_clause(TIED, *RUNS, TREE_PICK) + tree
    sql["eval_tree_thresholds_volume"] = with_clause(SCORES, *RUNS, TREE_PICK) + tree
    gram = """SELECT round(threshold_f1, 6) AS threshold_f1, round(threshold_blocking, 6) AS threshold_blocking,
  round(threshold_hunting, 6) AS threshold_hunting FROM ngram_pick"""
    sql["eval_ngram_thresholds"] = with_clause(TIED, *RUNS, NGRAM_PICK) + gram
    sql["eval_ngram_thresholds_volume"] = with_clause(SCORES, *RUNS, NGRAM_PICK) + gram
    sql["eval_effective_thresholds"] = with_clause(TIED, *RUNS, TREE_PICK) + """
SELECT mode, round(threshold, 6) AS threshold, round(threshold * 0.35::DOUBLE, 6) AS suspicious_lower,
  round(threshold, 6) AS suspicious_upper FROM (
  SELECT 'blocking' AS mode, blocking_threshold AS threshold FROM tree_pick
  UNION ALL SELECT 'hunting', least(hunting_threshold * 1.5::DOUBLE, 0.55::DOUBLE) FROM tree_pick)"""
    sql["eval_confusion"] = with_clause(SCORES) + """
SELECT tn, fp, fn, tp, round(fp / (fp + tn)::DOUBLE, 6) AS fp_rate, round(fn / (fn + tp)::DOUBLE, 6) AS fn_rate FROM (
  SELECT count(*) FILTER (label = 0 AND score < 0.2) AS tn, count(*) FILTER (label = 0 AND score >= 0.2) AS fp,
    count(*) FILTER (label = 1 AND score < 0.2) AS fn, count(*) FILTER (label = 1 AND score >= 0.2) AS tp FROM scores)"""
    sql["eval_classification_report"] = with_clause(TIED, *REPORT_CTES) + REPORT_SQL
    sql["eval_false_alarm_grid"] = with_clause(SCORES, *grid_ctes("0.05::DOUBLE", "0.9::DOUBLE")) + """
SELECT k, round(threshold, 6) AS threshold, round(fp_rate, 6) AS fp_rate, round(fn_rate, 6) AS fn_rate FROM grid_rates"""
    sql["eval_repaired_hunting"] = with_clause(
        SCORES, *RUNS, TREE_PICK,
        *grid_ctes("(SELECT hunting_threshold FROM tree_pick)", "(SELECT blocking_threshold FROM tree_pick)"),
    ) + """
SELECT round(CASE WHEN start_rate > 0.1 THEN coalesce((SELECT threshold FROM grid_rates WHERE fp_rate <= 0.08
  ORDER BY k LIMIT 1), a) ELSE a END, 6) AS hunting_threshold, round(start_rate, 6) AS fp_rate_before
FROM (SELECT a, (SELECT fp_rate FROM grid_rates WHERE k = 0) AS start_rate FROM ends)"""
    sql["eval_overfit"] = (
        with_clause(TIED.replace("scores AS", "tied AS", 1), SCORES)
        + "SELECT round(a, 6) AS train_auc, round(b, 6) AS test_auc, (a - b > 0.05)::INT AS overfit FROM (SELECT "
        + auc_of("tied", "a") + ", " + auc_of("scores", "b") + ")"
    )

    # training data
    sql["train_dataset_summary"] = over_features("""
SELECT count(*) AS total, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS bad,
  round(count(*) FILTER (toxic = 1) / (count(*) FILTER (toxic = 0))::DOUBLE, 6) AS balance
FROM features JOIN labels ON file_id = doc_id""")
    sql["train_guarded"] = over_features("SELECT toxic AS label, count(*) AS n FROM features JOIN labels ON file_id = doc_id GROUP BY ALL")
    sql["train_split"] = over_features("SELECT * FROM one_split", SIGNS, *split_ctes("signs", "one", 0.2, 42))
    sql["train_split_three_ways"] = over_features(
        """SELECT * FROM one_split WHERE part = 'test' UNION ALL
SELECT file_id, label, CASE part WHEN 'test' THEN 'validation' ELSE part END FROM two_split""",
        SIGNS, *split_ctes("signs", "one", 0.15, 42),
        "remaining AS (SELECT file_id, label FROM one_split WHERE part = 'train')",
        *split_ctes("remaining", "two", 0.15, 43),
    )
    sql["train_folds"] = over_features(
        """SELECT file_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(file_id || ':fold42'), file_id)
  - 1) % 3)::INT AS fold FROM signs""",
        SIGNS,
    )
    cuts = ", ".join(f"{c}::DOUBLE" for c in GAIN_CUTS)
    listed_names = ", ".join(quote(c) for c in FEATURES)
    score = "power(greatest(abs({0}g) - 0.2::DOUBLE, 0), 2) / ({0}h + 0.2::DOUBLE)"
    sql["train_split_gains"] = over_features(
        f"""SELECT feature, ([{cuts}])[bin + 1] AS cut, round(gain, 4) AS gain, below_n::BIGINT AS rows_below FROM (
  SELECT *, {score.format("below_")} + {score.format("above_")} - {score.format("all_")} AS gain FROM (
    SELECT *, all_g - below_g AS above_g, all_h - below_h AS above_h, all_n - below_n AS above_n FROM (
      SELECT feature, bin, sum(g) OVER upto AS below_g, sum(h) OVER upto AS below_h, sum(n) OVER upto AS below_n,
        sum(g) OVER every AS all_g, sum(h) OVER every AS all_h, sum(n) OVER every AS all_n FROM histogram
      WINDOW every AS (PARTITION BY feature), upto AS (PARTITION BY feature ORDER BY bin)))
  WHERE least(below_n, above_n) >= 10 AND least(below_h, above_h) >= 0.001::DOUBLE) WHERE gain > 0""",
        SIGNS,
        f"""cells AS (SELECT label, w, unnest([{listed_names}]) AS feature, unnest([{plain}]) AS value
  FROM (SELECT *, {WEIGHT.replace("file_id % 3 <> 1", "label <> 1")} AS w FROM features JOIN signs USING (file_id)))""",
        f"""histogram AS (SELECT feature, len(list_filter([{cuts}], lambda c: c < value)) AS bin,
  sum(w * (0.5::DOUBLE - label)) AS g, sum(w * 0.25::DOUBLE) AS h, count(*) AS n FROM cells GROUP BY ALL)""",
    )
    sql["train_sample_weights"] = over_features(f"SELECT file_id, {WEIGHT} AS weight FROM features")
    sql["train_weight_audit"] = over_features(f"""
SELECT count(*) AS samples, count(*) FILTER (w > 1) AS weighted, count(*) FILTER (w = 3) AS high,
  count(*) FILTER (w = 1.5) AS medium FROM (SELECT {WEIGHT} AS w FROM features)""")
    sql["train_class_weights"] = over_features(
        """SELECT label, n, round(t / (2.0::DOUBLE * n), 6) AS weight FROM (
  SELECT label, count(*) AS n, (SELECT count(*) FROM signs) AS t FROM signs GROUP BY label)""",
        SIGNS,
    )

    sql["train_nearest_neighbours"] = """
SELECT vec_id, count(*) AS found, round(max(d), 6) AS farthest, round(min(d), 6) AS closest FROM (
  SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (
    PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r <= 10 GROUP BY vec_id"""

    # n-grams
    listed = "SELECT term, files, uses, round(idf, 6) AS idf FROM {0}_vocab"
    rule = "((length(term) * 7 + files) % 11 - 5) / 10.0::DOUBLE AS coefficient"
    given = " UNION ALL ".join(f"SELECT '{b}' AS block, term, {rule} FROM {b}_vocab" for b in ("char", "word"))
    cells = " UNION ALL ".join(f"SELECT '{b}' AS block, file_id, term, value FROM {b}_weights" for b in ("char", "word"))
    sql["score_linear"] = over_grams(f"""
SELECT file_id, round(1 / (1 + exp(0.25 - coalesce(sum(value * coefficient), 0))), 6) AS prob_ngram
FROM corpus LEFT JOIN (({cells}) JOIN ({given}) USING (block, term)) USING (file_id) GROUP BY file_id""")
    def grid_gram_ctes(penalties: list[tuple[float, float]]) -> list[str]:
        listed = ", ".join(f"({k}, {c}::DOUBLE, {share}::DOUBLE)" for k, (c, share) in enumerate(penalties))
        both = " UNION ALL ".join(f"SELECT '{b}' AS block, term, files FROM {b}_vocab" for b in ("char", "word"))
        return [
            f"penalties AS (SELECT * FROM (VALUES {listed}) t(k, c, l1_share))",
            f"""given AS (SELECT block, term, k, ((length(term) * 7 + files + 3 * k) % 11 - 5) / 10.0::DOUBLE AS coefficient
      FROM ({both}), penalties)""",
            "marked AS (SELECT file_id, (file_id % 3 = 1)::INT AS label FROM corpus)",
            """placed AS (SELECT file_id, label, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY label)) AS weight,
      (row_number() OVER (PARTITION BY label ORDER BY md5(file_id || ':fold42'), file_id) - 1) % 3 AS fold FROM marked)""",
            f"cells AS MATERIALIZED ({cells})",
            """sums AS (SELECT file_id, k, sum(value * coefficient) AS total FROM cells JOIN given USING (block, term) GROUP BY ALL)""",
            """scores AS MATERIALIZED (SELECT file_id, label, weight, fold, k, 1 / (1 + exp(0.25 - coalesce(total, 0))) AS score
      FROM (placed CROSS JOIN penalties) LEFT JOIN sums USING (file_id, k))""",
        ]

    sql["train_grid_auc"] = with_clause(*gram_ctes(), *grid_gram_ctes([(c, s) for c in GRID.c for s in GRID.l1_share]), """
tied AS (SELECT k, fold, round(score, 9) AS score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores GROUP BY ALL),
below AS (SELECT *, sum(neg) OVER (PARTITION BY k, fold ORDER BY score) - neg / 2.0::DOUBLE AS beaten FROM tied)""") + """
SELECT c, l1_share, fold::INTEGER AS fold, round(sum(pos * beaten) / (sum(pos) * sum(neg)), 6) AS auc
FROM below JOIN penalties USING (k) GROUP BY ALL"""
    sql["train_grid_certificate"] = with_clause(*gram_ctes(), *grid_gram_ctes([(c, s) for c in KKT_C for s in KKT_L1]), """
folds AS (SELECT unnest([0, 1, 2]) AS held),
sizes AS (SELECT held, sum(weight) AS w, count(*) AS n FROM placed JOIN folds ON fold <> held GROUP BY held),
errors AS MATERIALIZED (SELECT file_id, k, held, weight * (score - label) AS e FROM scores JOIN folds ON fold <> held),
slopes AS (SELECT block, term, k, held, sum(value * e) AS g FROM cells JOIN errors USING (file_id) GROUP BY ALL),
terms AS (SELECT c, l1_share, held, coefficient AS b, coalesce(g, 0) / w AS g, 1 / (c * n) AS each
  FROM (given JOIN penalties USING (k) CROSS JOIN sizes) LEFT JOIN slopes USING (block, term, k, held)),
far AS (
  SELECT c, l1_share, held, CASE WHEN b <> 0 THEN abs(g + each * (1 - l1_share) * b + each * l1_share * sign(b))
    ELSE greatest(abs(g) - each * l1_share, 0) END AS v FROM terms
  UNION ALL SELECT c, l1_share, held, abs(sum(e) / max(w)) FROM errors JOIN penalties USING (k) JOIN sizes USING (held) GROUP BY ALL)""") + """
SELECT c, l1_share, held::INTEGER AS fold, round(max(v), 6) AS violation FROM far GROUP BY ALL"""
    tagged = f"SELECT upper(block) || ':' || term AS term, coefficient FROM ({given})"
    sql["report_top_terms"] = over_grams(f"""
(SELECT term, round(coefficient, 6) AS coefficient, 'bad' AS side FROM ({tagged}) ORDER BY coefficient DESC, term LIMIT 15)
UNION ALL (SELECT term, round(coefficient, 6), 'clean' FROM ({tagged}) ORDER BY coefficient, term LIMIT 15)""")
    sql["report_nonzero"] = over_grams(f"""
SELECT count(*) AS terms, count(*) FILTER (coefficient <> 0) AS nonzero,
  round(count(*) FILTER (coefficient <> 0) / count(*)::DOUBLE * 100, 6) AS percent FROM ({given})""")
    sql["sink_importances"] = over_features(f"SELECT feature, files::DOUBLE AS importance FROM ({active})")
    sql["sink_metadata"] = with_clause(TIED, *RUNS, TREE_PICK) + f"""
SELECT round(blocking_threshold, 6) AS blocking_threshold, round(hunting_threshold, 6) AS hunting_threshold,
  '1' AS extractor_version, {len(FEATURES)}::BIGINT AS features FROM tree_pick"""
    sql["report_top_importances"] = over_features(
        f"SELECT feature, files::DOUBLE AS importance FROM ({active}) ORDER BY importance DESC, feature LIMIT 20"
    )
    sql["ngram_vocabulary_char"] = over_grams(listed.format("char"))
    sql["ngram_vocabulary_word"] = over_grams(listed.format("word"))
    sql["ngram_vocabulary_ids"] = over_grams("""
SELECT block, term, row_number() OVER (ORDER BY block, term) - 1 AS term_id FROM (
  SELECT 'char' AS block, term FROM char_vocab UNION ALL SELECT 'word', term FROM word_vocab)""")
    for b in ("char", "word"):
        sql[f"ngram_weights_{b}"] = over_grams(f"""
SELECT file_id, count(value) AS terms, coalesce(round(sum(value), 6), 0) AS total,
  coalesce(round(max(value), 6), 0) AS largest FROM corpus LEFT JOIN {b}_weights USING (file_id) GROUP BY file_id""")
    sql["ngram_fill"] = over_grams("""
SELECT filled, files, terms, round(100.0::DOUBLE * filled / (files * terms), 6) AS fill_percent FROM (
  SELECT (SELECT count(*) FROM char_raw) + (SELECT count(*) FROM word_raw) AS filled, (SELECT n FROM n_files) AS files,
    (SELECT count(*) FROM char_vocab) + (SELECT count(*) FROM word_vocab) AS terms)""")
    return sql


ORACLE = build()
