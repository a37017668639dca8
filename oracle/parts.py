"""SQL building blocks for the comparison statements: text helpers and named intermediate tables (CTEs)."""

from __future__ import annotations

import re

from voc import rules, wording as w
from voc.plans.feedback_view import FEEDBACK_SQL
from voc.plans.samples import PROPOSALS_SQL
from voc.schemas import THEME_COLUMNS
from voc.settings import DEFAULT

RULES = rules.theme_rules(DEFAULT)
STOP_WORDS = rules.stop_words(DEFAULT)
SEP = "' | '"
WORD_CHAR = r"[\p{L}\p{N}_]"
NO_WORD_CHAR = r"[^\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return f"[{', '.join(q(v) for v in values)}]::varchar[]"


def any_in(expr: str, words) -> str:
    return "(" + " or ".join(f"contains({expr}, {q(x)})" for x in words) + ")"


def _portable(pattern: str) -> str:
    """Word boundaries that also hold beside letters outside of ASCII, where this engine's own see none."""
    inner = re.fullmatch(r"\\b\((.*)\)\\b", pattern)
    if not inner:
        return pattern
    parts = inner.group(1).split("|")
    # after a word character none may follow; after another character one has to
    ends = [p + (WORD_CHAR if p.endswith("/") else f"(?:$|{NO_WORD_CHAR})") for p in parts]
    return f"(?:^|{NO_WORD_CHAR})(?:{'|'.join(ends)})"


def matches(expr: str, patterns) -> str:
    return f"regexp_matches({expr}, {q('|'.join(f'(?:{_portable(p)})' for p in patterns))})"


def cases(branches, default: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in branches) + f" else {default} end"


def values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(r) + ")" for r in rows) + ")"


def round1(x: str) -> str:
    """Decimal formatting rounds by the exact binary value."""
    return f"cast(printf('%.1f', cast({x} as double)) as double)"


def formatted(template: str, *args: str) -> str:
    parts = re.split(r"%(\d)\$s", template)
    return " || ".join(q(p) if i % 2 == 0 else f"cast({args[int(p) - 1]} as varchar)" for i, p in enumerate(parts))


def clean(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '[\\r\\n\\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, 'https?://\\S+|www\\.\\S+', '', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


EMAIL = r"[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+"


def redact(x: str) -> str:
    for pattern, mark in (
        (EMAIL, "[REDACTED_EMAIL]"), (rules.PHONE, "[REDACTED_PHONE]"), (rules.HANDLE, "@user"),
        (rules.LONG_ID, "[REDACTED_ID]"),
    ):
        x = f"regexp_replace({x}, {q(pattern)}, {q(mark)}, 'g')"
    return x


def word_count(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '#+\\s+', '', 'g'), '[-*]\\s+', '', 'g')"
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> ''))"


def paraphrase(x: str) -> str:
    first = f"split_part({redact(x)}, '.', 1)"
    limit = w.NOTE_QUOTE_CHARS
    short = f"case when length({first}) > {limit} then substring({first}, 1, {limit - 3}) || '...' else {first} end"
    return f"""'"Customer says: ' || {strip(short)} || '"'"""


def is_noise(x: str) -> str:
    return (
        f"case when {matches(x, rules.RESIDUAL_SPAM_PATTERNS)} then true "
        f"when {matches(x, rules.BEHAVIOUR_PATTERNS)} then false else {matches(x, rules.NOISE_PATTERNS)} end"
    )


def domain(x: str) -> str:
    return cases([(any_in(x, ws), q(n)) for n, ws in rules.DOMAIN_WORDS], q(rules.GENERAL_DOMAIN))


def sentiment(text: str, rating: str) -> str:
    words = f"list_distinct(string_split_regex(lower({text}), '\\s+'))"
    pos = f"len(list_intersect({words}, {strings(rules.POSITIVE_WORDS)}))"
    neg = f"len(list_intersect({words}, {strings(rules.NEGATIVE_WORDS)}))"
    return cases(
        [(f"{rating} >= 4", "'positive'"), (f"{rating} > 0 and {rating} <= 2", "'negative'"),
         (f"{pos} > {neg}", "'positive'"), (f"{neg} > {pos}", "'negative'"), (f"{pos} > 0", "'mixed'")],
        "'neutral'",
    )


def volume(n: str, total: str) -> str:
    pct = f"(cast({n} as double) / {total} * 100)"
    return cases([(f"{pct} >= 10", "5.0::double"), (f"{pct} >= 6", "4.0::double"), (f"{pct} >= 3", "3.0::double"),
                  (f"{pct} >= 1", "2.0::double")], "1.0::double")


def prevalence(n: str, total: str, n_sources: str) -> str:
    return f"least(5.0::double, {volume(n, total)} + ({n_sources} - 1) * 0.5::double)"


def action(rel: str, prev: str, sig: str) -> str:
    r = f"upper(trim({rel}))"
    return cases(
        [(f"{r} = 'OUT_OF_SCOPE'", q(w.OUT_ACTION)), (f"{r} = 'DIRECT' and {prev} >= 3 and {sig} >= 3", q(w.PROMOTE)),
         (f"{r} = 'INDIRECT' or ({r} = 'DIRECT' and {prev} >= 3)", q(w.MONITOR)), (f"{sig} >= 3", q(w.NICHE))],
        q(w.DROP),
    )


def action_rank(a: str) -> str:
    return cases([(f"{a} = {q(x)}", str(i)) for i, x in enumerate(w.ACTION_ORDER, 1)], "99")


def confidence(n: str, rel: str) -> str:
    return cases([(f"{n} >= 80 and {rel} = 'DIRECT'", "'High'"), (f"{n} >= 30", "'Medium'")], "'Low'")


def confidence_text(n: str, rel: str, sources: str, opposing: str) -> str:
    count = f"case when len({sources}) > 0 then len({sources}) else 2 end"
    names = f"case when len({sources}) > 0 then array_to_string({sources}, ', ') else {q(w.DEFAULT_SOURCES)} end"
    args = (count, names, n, opposing)
    return cases(
        [(f"{n} >= 80 and {rel} = 'DIRECT'", formatted(w.CONFIDENCE["High"], *args)),
         (f"{n} >= 30", formatted(w.CONFIDENCE["Medium"], *args))],
        formatted(w.CONFIDENCE["Low"], *args),
    )


def trace(facts: str, theme: str, rel: str) -> str:
    low = f"lower({theme})"
    steps = cases([(any_in(low, ws), q(t)) for ws, t in w.TRACES], q(w.OTHER_TRACE))
    return f"case when {rel} = 'OUT_OF_SCOPE' then {q(w.OUT_TRACE)} else coalesce({facts}[1], {q(w.FIRST_FACT)}) || {steps} end"


def evidence(issue: str, theme: str) -> tuple[str, str]:
    low = f"(lower({issue}) || ' ' || lower({theme}))"
    texts, counts = [], []
    for i, (name, words, _) in enumerate(rules.EVIDENCE_GROUPS):
        hit = f"{any_in(low, words)} and e{i}_n > 0"
        texts.append((hit, f"{q(w.EVIDENCE_LEAD)} || e{i}_n || {q(w.EVIDENCE_TEXT[name])} || '\"' || substring(e{i}_text, 1, 90) "
                           f"|| '...\"' || {q(w.EVIDENCE_TAIL[name])}"))
        counts.append((hit, f"e{i}_n"))
    none = f"{q(w.NO_EVIDENCE[0])} || format('{{:,}}', total) || {q(w.NO_EVIDENCE[1])}"
    return cases(texts, none), cases(counts, "0")


def evidence_quotes(quotes: str, issue: str) -> str:
    li = f"lower({issue})"
    off = f"({any_in('lower(x)', rules.OFF_TOPIC_QUOTES)} or (contains(lower(x), {q(rules.OFF_TOPIC_FOR_AVAILABILITY)}) and contains({li}, 'availability')))"
    keep = cases([(off, "false")] + [(any_in(li, a), any_in("lower(x)", b)) for a, b in rules.QUOTE_GROUPS], "true")
    kept = f"list_filter({quotes}, lambda x: {keep})"
    return f"(case when len({kept}) > 0 then {kept} else {quotes} end)[1:3]"


def normalized_theme(t: str) -> str:
    low = f"lower(trim({t}))"
    product = any_in(low, ("constitution", "book", "monster", "iphone", "earphone"))
    return cases(
        [(f"{any_in(low, ('refund', 'quality', 'return'))} and not contains({low}, 'trust')", q(w.TRUST_THEME)),
         (f"{product} and {any_in(low, ('book', 'constitution', 'availability'))}", q(w.ASSORTMENT_THEME)),
         (product, q(w.NICHE_THEME))],
        t,
    )


def relevance(t: str) -> str:
    low = f"lower({t})"
    return cases(
        [(any_in(low, ("trust in high-value", "assortment gaps")), "'DIRECT'"),
         (any_in(low, ("fee", "charge", "time", "delivery", "payment", "coupon", "support")), "'INDIRECT'")],
        "'OUT_OF_SCOPE'",
    )


def critic(source: str) -> str:
    """The critic rules over a table of proposals."""
    named = f"select * replace ({normalized_theme('theme_name')} as theme_name) from {source}"
    low = "lower(theme_name)"
    out, ind = "rel = 'OUT_OF_SCOPE'", "rel = 'INDIRECT'"
    mech = strip("behavioral_mechanism")
    hedged = f"(starts_with({mech}, 'May contribute') or starts_with({mech}, 'Could influence'))"
    trust, assort = any_in(low, ("high-value", "trust")), any_in(low, ("assortment", "niche"))
    text, n = evidence("primary_issue", "theme_name")
    reasons = cases([(f"rel = {q(k)}", q(v)) for k, v in list(w.RELEVANCE_REASONS.items())[:2]], q(w.RELEVANCE_REASONS[w.OUT]))
    opportunity = cases(
        [(out, "''"), (f"{ind} and {any_in(low, ('fee', 'charge'))}", q(w.FEES_OPPORTUNITY)),
         (f"{ind} and {any_in(low, ('time', 'delivery'))}", q(w.TIMELINESS_OPPORTUNITY)),
         (f"{ind} and contains({low}, 'payment')", q(w.PAYMENT_OPPORTUNITY)), (ind, q(w.GENERAL_OPPORTUNITY)),
         (trust, q(w.TRUST_OPPORTUNITY)), (assort, q(w.ASSORTMENT_OPPORTUNITY))], q(w.OTHER_DIRECT_OPPORTUNITY))
    hypothesis = cases(
        [(out, q(w.OUT_HYPOTHESIS)), (ind, q(w.INDIRECT_HYPOTHESIS)), (trust, q(w.TRUST_HYPOTHESIS)),
         (assort, q(w.ASSORTMENT_HYPOTHESIS))], q(w.OTHER_DIRECT_HYPOTHESIS))
    return f"""
    select * exclude (behavioral_mechanism, research_questions, out_of_scope_reason, rel),
      rel as research_relevance, {reasons} as relevance_reason,
      case when {out} then {q(w.OUT_MECHANISM)}
           when {ind} and not {hedged} then {q(w.INDIRECT_MECHANISM[0])} || {mech} || {q(w.INDIRECT_MECHANISM[1])}
           else behavioral_mechanism end as behavioral_mechanism,
      {opportunity} as product_opportunity, {hypothesis} as research_hypothesis,
      case when {out} then []::varchar[] else research_questions end as research_questions,
      case when {out} and out_of_scope_reason = '' then {q(w.OUT_REASON)} else out_of_scope_reason end as out_of_scope_reason,
      {text} as contradictory_evidence, {n} as opposing,
      {trace('observed_facts', 'theme_name', 'rel')} as reasoning_trace,
      {confidence('n', 'rel')} as confidence, {confidence_text('n', 'rel', 'sources', n)} as confidence_explanation
    from (select *, {relevance('theme_name')} as rel from ({named}))
    """


_STANDING = (
    (("refund", "return", "defective", "high-value", "quality"), w.TRUST_THEME, "DIRECT", w.TRUST_OPPORTUNITY, None),
    (("assortment", "availability", "niche", "book", "choice", "selection", "variety", "limited"),
     w.ASSORTMENT_THEME, "DIRECT", w.ASSORTMENT_OPPORTUNITY, w.ASSORTMENT_HYPOTHESIS),
    (("fee", "charge", "surge"), w.FEES_THEME, "INDIRECT", w.FEES_OPPORTUNITY, None),
    (("delivery", "time"), w.TIMELINESS_THEME, "INDIRECT", w.TIMELINESS_OPPORTUNITY, None),
    (("payment", "cod"), w.PAYMENT_THEME, "INDIRECT", w.PAYMENT_OPPORTUNITY, None),
)


def renamed(source: str) -> str:
    low = "lower(theme)"

    def pick(i: int, old: str) -> str:
        return cases([(any_in(low, s[0]), q(s[i]) if s[i] is not None else old) for s in _STANDING], old)

    return (
        f"select * replace ({pick(1, 'theme')} as theme, {pick(2, 'research_relevance')} as research_relevance, "
        f"{pick(3, 'product_opportunity')} as product_opportunity, {pick(4, 'research_hypothesis')} as research_hypothesis) "
        f"from {source}"
    )


def merged(source: str, key: str, signal: str) -> str:
    """First rows of a key with summed counts; single rows untouched."""
    many = "members > 1"
    n_all, rel = "all_frequency", "research_relevance"
    prev = prevalence(n_all, "total", "len(all_sources)")
    return f"""
    select * exclude (mk, rn, members, all_frequency, max_signal, all_sources, all_quotes)
      replace (all_frequency as frequency,
        case when {many} then all_sources else sources end as sources,
        case when {many} then all_quotes[1:3] else example_quotes end as example_quotes,
        {signal} as signal_strength_score,
        case when {many} then {prev} else prevalence_score end as prevalence_score,
        case when {many} then {action(rel, f'({prev})', f'({signal})')} else action end as action,
        case when {many} then {confidence(n_all, rel)} else confidence end as confidence,
        case when {many} then {confidence_text(n_all, rel, 'all_sources', '0')} else confidence_explanation end as confidence_explanation)
    from (select *, {key} as mk, row_number() over (partition by {key} order by cluster_ord) as rn from {source}) a
    join (select mk as gk, members, all_frequency, max_signal, {distinct_in_order('s')} as all_sources, {distinct_in_order('qs')} as all_quotes
          from (select {key} as mk, count(*) as members, cast(sum(frequency) as bigint) as all_frequency,
                       max(signal_strength_score) as max_signal, flatten(list(sources order by cluster_ord)) as s,
                       flatten(list(example_quotes order by cluster_ord)) as qs from {source} group by 1)) b on a.mk = b.gk
    where rn = 1
    """.replace("exclude (mk,", "exclude (mk, gk,")


def _label_values() -> str:
    fields = list(w.LABELS[w.DEFAULT_LABEL])
    rows = []
    for key, t in w.LABELS.items():
        row = [q(key)]
        for f in fields:
            v = t[f]
            row.append(strings([w.branded(x, DEFAULT.brand) for x in v]) if isinstance(v, list) else q(w.branded(v, DEFAULT.brand)))
        rows.append(row)
    return f"select * from {values(rows)} as t(label_key, {', '.join(fields)})"


_E = range(len(rules.EVIDENCE_GROUPS))
_SENT = rules.SENTIMENT_ORDER


def _e(i: int) -> str:
    return any_in("lower(cleaned_text)", rules.EVIDENCE_GROUPS[i][2])


def _dominant() -> str:
    top = f"greatest({', '.join(_SENT)})"
    return cases([(f"{m} = {top}", q(m)) for m in _SENT[:-1]], q(_SENT[-1]))


_SPACE = r"\s+"
TOKENS = f"regexp_extract_all(lower(cleaned_text), {q(WORD_CHAR + '{2,}')})"

# name -> (tables it reads, select)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "feedback": ((), FEEDBACK_SQL),
    "ingested": (("feedback",),
                 "select * from feedback where length(text) > 10 qualify row_number() over (partition by text order by ord) = 1"),
    "cleaned": (("ingested",),
                f"select * from (select *, {clean('text')} as cleaned_text from ingested) where length(cleaned_text) >= 20 "
                f"and not {matches('lower(cleaned_text)', rules.SPAM_PATTERNS)} "
                "qualify row_number() over (partition by cleaned_text order by ord) = 1"),
    "flagged": (("cleaned",), f"select *, {is_noise('lower(cleaned_text)')} as is_noise from cleaned"),
    "filtered": (("flagged",), "select * from flagged where not is_noise or not exists (select 1 from flagged where not is_noise)"),
    "classified": (("filtered",),
                   f"select *, {domain('lower(cleaned_text)')} as sub_domain, {sentiment('cleaned_text', 'rating')} as sentiment from filtered"),
    "cluster_ids": (("classified",),
                    "select sub_domain, row_number() over (order by sub_domain) - 1 as cluster_id from (select distinct sub_domain from classified)"),
    "source_order": (("classified",), "select sub_domain, list(source order by o) as sources from "
                     "(select sub_domain, source, min(ord) as o from classified group by all) group by 1"),
    "opposing": (("classified",), "select " + ", ".join(
        f"count(*) filter ({_e(i)}) as e{i}_n, arg_min(cleaned_text, ord) filter ({_e(i)}) as e{i}_text" for i in _E
    ) + " from classified where not is_noise"),
    "counts": (("classified", "cluster_ids", "source_order"),
               "select c.sub_domain, any_value(i.cluster_id) as cluster_id, any_value(s.sources) as sources, count(*) as n, "
               "cast(sum(length(cleaned_text)) as bigint) as chars, min(ord) as cluster_ord, "
               "(select count(*) from classified) as total, "
               + ", ".join(f"count(*) filter (sentiment = {q(m)}) as {m}" for m in _SENT)
               + " from classified c join cluster_ids i using (sub_domain) join source_order s using (sub_domain) group by 1"),
    "moods": (("counts",),
              "select *, " + ", ".join(f"{round1(f'cast({m} as double) / n * 100')} as {m}_pct" for m in _SENT)
              + f", {_dominant()} as dominant from counts"),
    "stats": (("moods", "opposing"),
              "select m.*, o.*, dominant || ' (' || negative_pct || '% negative, ' || positive_pct || '% positive, ' || neutral_pct || '% neutral)' as summary, "
              f"{prevalence('n', 'total', 'len(sources)')} as prevalence_score, "
              "greatest(1.0::double, least(5.0::double, case when cast(chars as double) / n >= 120 then 4.5::double "
              "when cast(chars as double) / n >= 70 then 3.5::double else 2.5::double end "
              "- case when positive_pct > 30 and negative_pct > 30 then 1.0::double else 0.0::double end)) as signal_strength_score "
              "from moods m, opposing o"),
    "samples": (("classified",),
                "select sub_domain, ord, cleaned_text, row_number() over (partition by sub_domain order by md5(ord || '|42'), ord) as place "
                "from classified qualify place <= 8"),
    "sample_lists": (("samples",), "select sub_domain, list(cleaned_text order by place) as sample_quotes from samples group by 1"),
    "words": (("classified",),
              f"select sub_domain, ord, unnest(list_filter({TOKENS}, lambda t: not list_contains({strings(STOP_WORDS)}, t))) as term from classified"),
    "keywords": (("words", "cluster_ids"),
                 "select c.sub_domain, coalesce(any_value(k.l), " + strings(rules.EMPTY_KEYWORDS) + ") as keywords from cluster_ids c left join "
                 "(select sub_domain, list(term order by place) as l from (select sub_domain, term, row_number() over "
                 "(partition by sub_domain order by count(*) desc, term) as place from words group by sub_domain, term qualify place <= 8) group by 1) k "
                 "using (sub_domain) group by 1"),
    "grams": (("classified",),
              "select sub_domain, ord, unnest(list_concat(t, list_transform(t[1:greatest(len(t) - 1, 0)], lambda x, i: x || ' ' || t[i + 1]))) as term from "
              f"(select sub_domain, ord, list_filter({TOKENS}, lambda t: not list_contains({strings(STOP_WORDS)}, t)) as t from classified)"),
    "terms": (("grams",), "select term, count(*) as tf, count(distinct ord) as df from grams group by 1 having count(distinct ord) >= 2"),
    "templates": ((), _label_values()),
    "proposed": (("stats", "sample_lists", "keywords", "templates"),
                 "select s.*, l.sample_quotes, k.keywords, t.* exclude (label_key), "
                 f"{evidence_quotes('l.sample_quotes', 't.primary_issue')} as example_quotes "
                 "from stats s join sample_lists l using (sub_domain) join keywords k using (sub_domain) join templates t on t.label_key = "
                 + cases([(any_in("lower(array_to_string(l.sample_quotes, ' '))", ws), q(k)) for k, ws in w.LABEL_WORDS], q(w.DEFAULT_LABEL))),
    "labels": (("proposed",), critic("proposed")),
    "scored": (("labels",),
               "select * from (select *, theme_name as theme, n as frequency, summary as sentiment, "
               f"{action('research_relevance', 'prevalence_score', 'signal_strength_score')} as action from labels)"),
    "scored_rows": (("scored",), f"select {', '.join(THEME_COLUMNS)}, cluster_ord, total from scored"),
    "merged1": (("scored_rows",), merged("scored_rows", "lower(trim(theme))", "max_signal")),
    "renamed1": (("merged1",), renamed("merged1")),
    "merged2": (("renamed1",), merged("renamed1", "theme", "signal_strength_score")),
    "ranked": (("merged2",),
               f"select *, row_number() over (order by {action_rank('action')}, prevalence_score + signal_strength_score desc, cluster_ord) as position from merged2"),
    "tagged": (("classified",),
               "select ord, source, rating, cleaned_text, list_filter([" + ", ".join(
                   f"case when {matches('lower(cleaned_text)', r.patterns)} then {q(r.theme_id)} end" for r in RULES)
               + "], lambda x: x is not null) as theme_ids from classified where length(cleaned_text) > 40"),
    "rule_table": ((), "select * from " + values([(str(i), q(r.theme_id), q(r.label), q(r.kind)) for i, r in enumerate(RULES)])
                   + " as t(rule_no, theme_id, label, class)"),
    "matched": (("tagged", "rule_table"),
                "select t.*, r.* from (select * exclude (theme_ids), unnest(theme_ids) as tid from tagged) t join rule_table r on r.theme_id = t.tid"),
    "proposals": ((), PROPOSALS_SQL),
    "judged": (("proposals",), critic("proposals")),
    "lines": ((), "select doc_id, unnest(l) as line_text, generate_subscripts(l, 1) as line from (select doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]') as l from documents)"),
}


def insights(source: str, extra: str) -> str:
    out = f"(research_relevance = 'OUT_OF_SCOPE' or action = {q(w.OUT_ACTION)})"
    risk = any_in("theme", w.INSIGHT_WORDS)
    question = q(w.branded(w.RISK_QUESTION, DEFAULT.brand))
    return f"""
    select * exclude (out_of_scope_reason),
      case when {out} then 'Out of Scope' else 'In Scope' end as status,
      case when {out} then '' when {risk} then {q(w.RISK_INSIGHT)} else {q(w.GENERAL_INSIGHT)} end as suggested_insight,
      case when {out} then '' when {risk} then {question} else {q(w.GENERAL_QUESTION)} end as suggested_research_question,
      case when {out} and out_of_scope_reason = '' then {q(w.OUT_REASON_FORMAT[0])} || primary_issue || {q(w.OUT_REASON_FORMAT[1])}
           else out_of_scope_reason end as out_of_scope_reason,
      case when theme = {q(w.ASSORTMENT_THEME)} then {q(w.RELEVANCE_REASONS[w.DIRECT])} end as relevance_reason
    from {source} {extra}
    """


TABLES["themes"] = (("ranked",), insights("ranked", ""))


def findings(lines: str, key: str) -> str:
    """All personal-data findings of a table of (key, line, line_text)."""
    short = "(contains(m, '-') and length(trim(replace(m, '-', ''))) < 8)"
    phones = (
        f"list_filter(regexp_extract_all(line_text, {q(rules.PHONE)}), lambda m: not regexp_matches(m, {q(rules.DATE_IN_PHONE)}) "
        f"and not {short} and not contains(line_text, '%'))"
    )
    sets = {
        "email": f"regexp_extract_all(line_text, {q(EMAIL)})", "phone": phones,
        "handle": f"regexp_extract_all(line_text, {q(rules.HANDLE)})",
        "long_numeric_id": f"regexp_extract_all(line_text, {q(rules.LONG_ID)})",
    }
    return " union all ".join(
        f"select {key}, line, {q(t)} as type, unnest(f) as match, generate_subscripts(f, 1) as place from (select {key}, line, {x} as f from {lines})"
        for t, x in sets.items()
    )


TABLES["pii"] = (("lines",), findings("lines", "doc_id"))


def with_tables(select: str, *names: str) -> str:
    """The statement with all named tables and what they read, each once and in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in TABLES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    ctes = ", ".join(f"{n} as materialized ({TABLES[n][1]})" for n in order)
    return f"with {ctes} {select}" if order else select
