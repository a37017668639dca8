"""One SQL statement per registered query, for comparison on the same tables."""

from __future__ import annotations

from oracle.parts import (
    action, action_rank, cases, clean, confidence, confidence_text, evidence, evidence_quotes, findings,
    insights, is_noise, matches, paraphrase, prevalence, q, redact, renamed, round1, strings, strip, trace, with_tables, word_count,
    TOKENS as _TOKENS,
)
from voc import rules, wording as w
from voc.operators import stability
from voc.plans.catalog import CRITIC_COLUMNS, LABEL_COLUMNS, LIST_SEP
from voc.schemas import RESULT_THEME, THEME_COLUMNS
from voc.settings import DEFAULT

_ARRAYS = {"observed_facts", "alternative_explanations", "research_questions", "assumptions", "example_quotes", "sources", "keywords"}


def _flat(columns) -> str:
    return ", ".join(f"array_to_string({c}, {q(LIST_SEP)}) as {c}" if c in _ARRAYS else c for c in columns)


_PLAY = """
select doc_id as ord, 'ps_' || doc_id as id, 'play_store' as source, {text} as text,
  cast(coalesce(case when doc_id % 13 <> 0 then doc_id % 6 end, 0) as double) as rating,
  strftime(timestamp '2024-01-01 00:00:00' + to_minutes(cast(doc_id as bigint)), '%Y-%m-%d %H:%M:%S') as date,
  cast(doc_id % 50 as int) as upvotes, {url} as url from documents
""".format(text=strip("case when doc_id % 11 <> 0 then text end"), url=q(DEFAULT.play_url))

_FEED_TITLE = "case when doc_id % 3 <> 0 then 'Title ' || doc_id else '' end"
_FEED_BODY = "case when doc_id % 4 <> 0 then text else '' end"


def _titled(title: str, body: str) -> str:
    return strip(f"case when {title} <> '' and {body} <> '' then {title} || ' - ' || {body} else {title} || {body} end")


_POST = strip("'T' || doc_id % 10 || chr(10) || text")
_COMMENT = strip("text")
_FORUM = f"""
select id, subreddit, text, cast(score as int) as score, url, created_utc, type, pos from (
  select 'sub_' || doc_id // 2 as id, 'india' as subreddit, {_POST} as text, doc_id % 9 as score,
    case when doc_id % 2 = 0 then 'https://x/' || doc_id else 'https://reddit.com/r/india/comments/' || doc_id // 2 end as url,
    doc_id as created_utc, 'post' as type, doc_id * 1048576 * 2 as pos, 15 as least_chars from documents
  union all
  select 'com_' || doc_id // 2, 'delhi', {_COMMENT}, doc_id % 4, 'https://reddit.com/r/delhi/' || doc_id, doc_id, 'comment',
    doc_id * 1048576 * 2 + 1, 20 from documents
) where length(text) > least_chars and text not in ('[deleted]', '[removed]')
qualify row_number() over (partition by id order by pos) = 1
"""

_TERMS = ("Delivery", "order", "app", "refund")
_HITS = (
    "select f.*, t.term_no, t.term from feedback f join (values "
    + ", ".join(f"({i}, {q(t)})" for i, t in enumerate(_TERMS))
    + ") as t(term_no, term) on contains(lower(f.text), lower(t.term))"
)

_EVIDENCE_ISSUES = ("Payment Methods", "Delivery Experience", "Refunds / Returns", "Pricing / Fees", "Other")
_ev_text, _ev_n = evidence("primary_issue", "sub_domain")

_PROPOSED_ACTION = action("relevance", "prev", "sig")


def _bucket(a: str) -> str:
    return cases(
        [(f"{a} = {q(w.PROMOTE)}", "'promote'"), (f"contains({a}, 'Monitor')", "'monitor'"), (f"contains({a}, 'Niche')", "'niche'"),
         (f"contains({a}, 'Out of Scope') or contains({a}, 'Drop')", "'out_of_scope'")], "'other'")


def _policies() -> str:
    """Candidate policies as rows with their condition, numbered per theme."""
    mech, area = "lower(behavioral_mechanism)", "lower(primary_issue)"
    opp = f"lower(case when doc_id % 3 = 0 then {q(w.TRUST_OPPORTUNITY)} else '' end)"
    trust = f"regexp_matches({mech}, 'trust|quality|loss') or regexp_matches({opp}, 'confidence|trust') or contains({area}, 'quality')"
    delivery = f"contains({area}, 'delivery') or regexp_matches({mech}, 'delivery|fulfil')"
    payment = f"contains({area}, 'payment') or regexp_matches({mech}, 'payment|uncertainty')"
    rows = []
    for k, (cond, p) in enumerate(
        [(trust, x) for x in w.TRUST_POLICIES] + [(delivery, w.DELIVERY_POLICY), (payment, w.PAYMENT_POLICY)]
        + [("true", x) for x in w.STANDING_POLICIES]
    ):
        name, status, value, source = p
        src = q(source) if source else "n || ' quality reviews across ' || len(sources) || ' sources'"
        rows.append(f"select cast(doc_id as varchar) as doc, {k} as k, {q(name)} as name, {q(status)} as status, "
                    f"{q(value) if value else 'null'} as value, {src} as source from proposals where {cond}")
    return ("select doc, row_number() over (partition by doc order by k) as place, name, status, value, source from ("
            + " union all ".join(rows) + ") qualify place <= 6")


_GATE = "select count(*) = 0 as passed, count(*) as blockers_count, " + ", ".join(
    f"count(*) filter (type = {q(t)}) as {t}" for t in rules.PII_TYPES
)
_META = f"""
select max(total) as total_feedback_analyzed, count(*) as total_themes_discovered,
  count(*) filter (action = {q(w.PROMOTE)}) as promoted_research_questions_count,
  count(*) filter (action = {q(w.OUT_ACTION)}) as out_of_scope_themes_count,
  cast(sum(len(list_filter(sources, lambda s: s = 'play_store'))) as double) / sum(len(sources)) * 100 as share
from themes
"""
_WARNING = f"case when share > 70 then {q(w.COVERAGE_WARNING[0])} || printf('%.1f', share) || {q(w.COVERAGE_WARNING[1])} else '' end"


def _result_column(title: str, name: str) -> str:
    if name == "example_quotes":
        return f"coalesce({name}[{title[-1]}], '') as \"{title}\""
    sep = ", " if name == "sources" else "; "
    return f"array_to_string({name}, '{sep}') as \"{title}\"" if name in _ARRAYS else f'{name} as "{title}"'


_NOTE_ROWS = f"""
select no, 'theme_' || cluster_id as id,
  theme || ' (Mentions: ' || frequency || ') — prevalence: ' || printf('%.1f', prevalence_score) || '/5.0 | signal: ' || printf('%.1f', signal_strength_score) || '/5.0' as headline,
  {paraphrase(f"coalesce(example_quotes[1], {q(w.NOTE_QUOTE_DEFAULT)})")} as paraphrased,
  {cases([(f"primary_issue = {q(k)}", q(v)) for k, v in w.NOTE_ACTIONS.items()],
         f"{q(w.NOTE_ACTION_DEFAULT[0])} || lower(primary_issue) || {q(w.NOTE_ACTION_DEFAULT[1])}")} as action
from (select *, row_number() over (order by position) as no from themes
      where (select count(*) from themes where research_relevance = 'DIRECT') < 3 or research_relevance = 'DIRECT')
where no <= 3
"""
_TITLE = w.branded(w.NOTE_TITLE, DEFAULT.brand) + "(2024-01-07)"


def _markdown(quote: str) -> str:
    def section(heading: str, line: str) -> str:
        return f"{q(heading)} || chr(10) || (select string_agg({line}, chr(10) order by no) from note_rows)"

    return (
        f"{q('# ' + _TITLE)} || chr(10) || chr(10) || " + section(w.NOTE_HEADINGS[0], "'- **' || headline || '**'")
        + " || chr(10) || chr(10) || " + section(w.NOTE_HEADINGS[1], f"'- ' || {quote}")
        + " || chr(10) || chr(10) || " + section(w.NOTE_HEADINGS[2], "'- ' || action") + " || chr(10)"
    )


_SHORT = "substring(paraphrased, 1, 60) || '...\"'"
_NOTE = (
    f"select {q(_TITLE)} as title, {word_count('md')} as word_count, total, md as markdown from (select case when {word_count('long')} > 250 "
    f"then short else long end as md, total from (select {_markdown('paraphrased')} as long, {_markdown(_SHORT)} as short, "
    "(select max(total) from themes) as total))"
)


def _note(select: str) -> str:
    """A statement over the note; the note rows and the note are added as further tables."""
    return with_tables(f", note_rows as materialized ({_NOTE_ROWS}), note as materialized ({_NOTE}) {select}", "themes")


_RULE_COUNTS = f"""
select theme_id, any_value(label) as label, any_value(class) as class, any_value(rule_no) as rule_no, count(*) as count,
  {round1('cast(100 * count(*) as double) / (select count(*) from tagged)')} as pct_of_substantive
from matched group by theme_id
"""
_RULE_QUOTES = (
    "select theme_id, row_number() over (partition by theme_id order by ord) as place, substring(cleaned_text, 1, 250) as quote "
    "from matched qualify place <= 8"
)

_CENTROIDS = """
with flat as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
means as (select label, list(m order by i) as centroid from (select label, i, avg(x) as m from flat group by label, i) group by label),
scored as (select e.vec_id, e.label, m.label as g, round(list_cosine_similarity(e.embedding::double[], m.centroid), 6) as cos from embeddings e, means m)
select vec_id, cast(label as bigint) as label, max(cos) filter (g = label) as own_cosine, max(cos) as best_cosine,
  cast(min(g) filter (cos = best) as bigint) as nearest
from (select *, max(cos) over (partition by vec_id) as best from scored) group by vec_id, label
"""



def _cat(*parts: str) -> str:
    """Columns, and literal texts marked by a leading =."""
    return " || ".join(q(p[1:]) if p.startswith("=") else p for p in parts)


def _lines(*lines: str) -> str:
    return f"array_to_string([{', '.join(lines)}], chr(10))"


def _join(name: str) -> str:
    return f"array_to_string({name}, ', ')"


_NL = "chr(10)"
_STOP = strings(rules.ENGLISH_STOP_WORDS)
_QUOTES = "array_to_string(list_transform(example_quotes[1:3], lambda x: '  > \"' || x || '\"' || chr(10)), chr(10))"
_PROMOTED = " || chr(10) || ".join((
    _lines(
        _cat("=### ", "row_number() over (partition by action order by position)", "=. ", "theme", _NL),
        _cat("=- **Primary Issue**: `", "primary_issue", "=` | **Relevance**: `", "research_relevance", "=` | **Journey Stage**: `", "customer_journey_stage", "=`", _NL),
        _cat("=- **Business Impact**: `", "business_impact", "=` | **Confidence**: `", "confidence", "=` (", "confidence_explanation", "=)", _NL),
        _cat("=- **Evidence Summary**: ", "evidence_summary", _NL),
        _cat("=- **Observed Facts**: ", _join("observed_facts"), _NL),
        _cat("=- **Observed Behavior (WHAT)**: ", "observed_behavior", _NL),
        _cat('=- **Behavioral Mechanism (WHY)**: *"', "behavioral_mechanism", '="*', _NL),
        _cat("=- **Underlying Need / JTBD**: ", "underlying_need", _NL),
        _cat("=- **Barrier / Driver**: ", "barrier_or_driver", _NL),
        _cat('=- **Product Opportunity (Solution-Agnostic)**: 🚀 **"', "product_opportunity", '="**', _NL),
        _cat('=- **Research Hypothesis**: 🧪 *"', "research_hypothesis", '="*', _NL),
        _cat("=- **Research Questions**: ", "array_to_string(list_transform(research_questions, lambda x: '\"' || x || '\"'), ', ')", _NL),
        _cat("=- **Alternative Explanations**: ", _join("alternative_explanations"), _NL),
        _cat("=- **Contradictory Evidence**: ", "contradictory_evidence", _NL),
        _cat("=- **Assumptions**: ", _join("assumptions"), _NL),
        _cat("=- **Full Reasoning Trace**: `", "reasoning_trace", "=`", _NL),
        _cat("=- **Supporting Verbatim Customer Evidence**:", _NL),
    ), _QUOTES, "chr(10) || '---' || chr(10)",
))
_WATCHED = _cat("=- **", "theme", "=** (`", "primary_issue", "=`) — Stage: ", "customer_journey_stage", "= | Impact: ", "business_impact",
                "= | Confidence: ", "confidence", _NL)
_ASIDE = _lines(
    _cat("=### 📌 ", "theme", _NL),
    _cat("=- **Primary Area**: `", "primary_issue", "=` | **Journey Stage**: `", "customer_journey_stage", "=` | **Mentions**: ", "frequency", _NL),
    _cat("=- **Out of Scope Rationale**: ", "out_of_scope_reason", _NL), _cat("=- **Sample Quote**:", _NL),
    "'  > \"' || example_quotes[1] || '\"' || chr(10)", _NL,
)


def _blocks(block: str, where: str, order: str = "position") -> str:
    return f"(select string_agg(b, chr(10) order by o) from (select {block} as b, {order} as o from themes where {where}))"


_MARKDOWN = f"""
select '# AI Product Discovery Engine — Master Knowledge Report' || chr(10) || chr(10)
  || '**Business Objective**: *Increase percentage of Monthly Active Customers purchasing from at least one new category every month.*' || chr(10) || chr(10) || chr(10)
  || '**Total Feedback Analyzed**: ' || total_feedback_analyzed || ' clean customer items across Play Store, App Store, and Reddit.' || chr(10) || chr(10)
  || case when {_WARNING} <> '' then '⚠️ **' || {_WARNING} || '**' || chr(10) || chr(10) || chr(10) else '' end
  || '## 🎯 Promoted Product Opportunities & Auditable Reasoning Chains' || chr(10) || chr(10)
  || coalesce({_blocks(_PROMOTED, f"action = {q(w.PROMOTE)}")}, '_No themes met the dual High Category Impact + High Signal Strength threshold._' || chr(10)) || chr(10)
  || coalesce(chr(10) || '## 📊 Secondary / Monitored Signals' || chr(10) || chr(10)
      || {_blocks(_WATCHED, "contains(action, 'Monitor') or contains(action, 'Niche')", "contains(action, 'Niche')::int * 1000 + position")} || chr(10), '')
  || chr(10) || '## 🛑 Out of Scope Themes (Routed to Operational Product Teams)' || chr(10) || chr(10)
  || coalesce({_blocks(_ASIDE, f"action = {q(w.OUT_ACTION)}")}, '_None_' || chr(10)) as markdown
from ({_META})
"""
_CONTEXT_BLOCK = (
    "chr(10) || " + _lines(
        _cat('=Theme: "', "theme", '="'), _cat("=  Primary Area: ", "primary_issue"), _cat("=  Relevance: ", "research_relevance"),
        _cat("=  Journey Stage: ", "customer_journey_stage"), _cat("=  Observed Facts: ", _join("observed_facts")),
        _cat("=  Observed Behavior: ", "observed_behavior"), _cat("=  Behavioral Mechanism: ", "behavioral_mechanism"),
        _cat("=  Underlying Need / JTBD: ", "underlying_need"), _cat("=  Barrier / Driver: ", "barrier_or_driver"),
        _cat("=  Business Impact: ", "business_impact", "= | Confidence: ", "confidence"),
        _cat("=  Product Opportunity: ", "product_opportunity"), _cat("=  Research Question: ", "suggested_research_question"),
        _cat("=  Action / Priority: ", "action"),
    )
    + " || case when out_of_scope_reason <> '' then chr(10) || '  Out of Scope Reason: ' || out_of_scope_reason else '' end"
    + " || chr(10) || '  Customer Quotes:' || chr(10) || array_to_string(list_transform(example_quotes, lambda x: '    - \"' || x || '\"'), chr(10))"
)
_CONTEXT = f"""
select '=== {DEFAULT.brand.upper()} CUSTOMER FEEDBACK CORPUS CONTEXT ===' || chr(10)
  || 'Total Feedback Analyzed: ' || total_feedback_analyzed || ' clean items' || chr(10)
  || 'Total Unique Themes: ' || total_themes_discovered || chr(10)
  || 'Promoted Interview Hypotheses: ' || promoted_research_questions_count || chr(10)
  || 'Out of Scope Themes: ' || out_of_scope_themes_count || chr(10) || chr(10)
  || '--- DISCOVERED THEMES & BEHAVIORAL MECHANISMS ---' || chr(10) || {_blocks(_CONTEXT_BLOCK, "true")} as context
from ({_META})
"""

_P = stability.PRIME
_INTERVALS = with_tables(
    f""", d as (select sub_domain, source, r, (ord % {_P} * (r * 7919 + 104729) + r) % {_P} as x, r * 12289 + 1 as m from classified, range({stability.REPLICATES}) as t(r)),
    h1 as (select *, (x * x + m) % {_P} as y from d), h2 as (select *, (y * y + 24593) % {_P} as z from h1), h3 as (select *, (z * z + 49157) % {_P} as h from h2),
    sums as (select sub_domain, r, source, sum({' + '.join(f'(h >= {b})::int' for b in stability.BOUNDS)}) as w, count(*) as n from h3 group by all),
    per as (select sub_domain, r, sum(w) as w, sum(n) as n, count_if(w > 0) as s from sums group by all),
    drawn as (select *, sum(w) over (partition by r) as total, sum(n) over (partition by r) as whole, rank() over (partition by r order by n desc) as rank,
      rank() over (partition by r order by w desc) as drawn_rank from per),
    scored as (select *, round(case when total > 0 then w::double / total * 100 else 0 end, 6) as drawn_share, {prevalence('w', 'total', 'greatest(s, 1)')} as drawn_score from drawn),
    lists as (select sub_domain, any_value(n) as n, any_value(whole) as whole, any_value(rank) as rank, list(drawn_share order by drawn_share) as a,
      list(drawn_score order by drawn_score) as b, list(drawn_rank order by drawn_rank) as c from scored group by 1)
    select sub_domain, n::bigint as n, round(n::double / whole * 100, 6) as share, rank, a[6] as share_low, a[-6] as share_high, b[6] as score_low, b[-6] as score_high,
      c[6] as rank_low, c[-6] as rank_high from lists""", "classified")

# links join by weight one after the other: ``part`` has the part of every vector
_FOREST = """
with recursive near as materialized (
  select u, v, d from (
    select a.vec_id as u, b.vec_id as v, round(1 - round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9), 9) as d,
      row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) as place
    from embeddings a join embeddings b on a.vec_id <> b.vec_id) where place <= 15
), core as materialized (select u, max(d) as core from near group by 1),
links as materialized (
  select least(n.u, n.v) as u, greatest(n.u, n.v) as v, min(greatest(d, cu.core, cv.core)) as w
  from near n join core cu on cu.u = n.u join core cv on cv.u = n.v group by 1, 2
), numbered as materialized (
  select l.*, row_number() over (order by w, u, v) as i from links l
), nodes as (select list(vec_id order by vec_id) as ids from embeddings),
placed as materialized (select i, w, list_position(ids, u) as a, list_position(ids, v) as b from numbered, nodes),
steps as (
  select cast(0 as bigint) as i, (select list_transform(ids, lambda x, j: j) from nodes) as part, cast(0 as bigint) as kept, cast(0 as double) as weight
  union all
  select p.i, case when part[a] = part[b] then part else list_transform(part, lambda x: case when x = part[a] then part[b] else x end) end,
    kept + (part[a] <> part[b])::bigint, weight + case when part[a] <> part[b] then w else 0 end
  from steps s join placed p on p.i = s.i + 1
)
select (select count(*) from links) as links, kept, round(weight, 6) as weight from steps order by i desc limit 1
"""

STATEMENTS: dict[str, str] = {
    # ---------------------------------------------------------------- sources
    "play_source": _PLAY,
    "two_loads": """select doc_id, doc_id % 2 + 1 as load from documents where text is null
        union all select doc_id, load from (select doc_id, doc_id % 2 + 1 as load, row_number() over (partition by text order by doc_id % 2, doc_id) as place
            from documents where text is not null) where place = 1""",
    "play_array": _PLAY.replace("doc_id as ord", "row_number() over (order by doc_id) - 1 as ord"),
    "app_source": f"""
        select {rules.SOURCE_STRIDE} + doc_id as ord, 'as_' || case when doc_id % 5 <> 0 then 'r' || doc_id else cast(doc_id as varchar) end as id,
          'app_store' as source, {strip('text')} as text, cast(coalesce(case when doc_id % 7 <> 0 then doc_id % 6 end, 0) as double) as rating,
          '' as date, cast(0 as int) as upvotes, {q(DEFAULT.app_store_url)} as url from documents""",
    "reddit_source": f"""
        select {2 * rules.SOURCE_STRIDE} + doc_id as ord, 'rd_sub_' || doc_id as id, 'reddit' as source, {strip('text')} as text,
          cast(null as double) as rating, cast(1704067200 + doc_id as varchar) as date, cast(doc_id % 9 as int) as upvotes,
          case when doc_id % 4 <> 0 then 'https://x/' || doc_id else '' end as url from documents""",
    "chosen_sources": "select 'play_store' as source, count(*) as n from documents union all select 'reddit', count(*) from documents",
    "review_dates": """
        select cast(doc_id as varchar) as "reviewId",
          strftime(timestamp '2024-01-01 00:00:00' + to_seconds(doc_id * 60), '%Y-%m-%d %H:%M:%S') as at,
          case when doc_id % 3 = 0 then strftime(timestamp '2024-01-01 00:00:00' + to_seconds(doc_id * 90), '%Y-%m-%d %H:%M:%S') end as "repliedAt"
        from documents""",
    "feed_payload": f"""
        select * from (select doc_id * 1048576 + 1 as pos, 'u' || doc_id as "userName", {_titled(_FEED_TITLE, _FEED_BODY)} as review,
          cast(case when doc_id % 7 <> 0 and doc_id % 5 <> 0 then doc_id % 6 else 0 end as int) as rating, '' as date, 'e' || doc_id as review_id
          from documents) where review <> ''""",
    "library_payload": f"""
        select * from (select doc_id as pos, 'u' || doc_id as "userName", {_titled(_FEED_TITLE, _FEED_BODY)} as review,
          cast(doc_id % 6 as int) as rating, '2024-01-01T00:00:00' as date, cast(doc_id as varchar) as review_id
          from documents) where review <> ''""",
    "forum_payload": _FORUM,
    "csv_files": with_tables("select ord, id, source, text, rating, upvotes, cleaned_text, is_noise from flagged", "flagged"),
    "source_counts": with_tables("select source, count(*) as n from feedback group by 1", "feedback"),
    "source_limits": with_tables(
        "select ord, source from feedback qualify source = 'reddit' or row_number() over (partition by source order by ord) "
        "<= case source when 'play_store' then 200 else 100 end", "feedback"),
    "search_terms": with_tables(f"select ord, cast(term_no as bigint) as term_no, term from ({_HITS})", "feedback"),
    "search_terms_once": with_tables(
        f"select id, ord, term from ({_HITS}) qualify row_number() over (partition by id order by term_no, ord) = 1", "feedback"),
    # ---------------------------------------------------------------- text
    "ingested": with_tables("select ord, id, source, text, rating, upvotes from ingested", "ingested"),
    "cleaned_texts": f"select doc_id, c as cleaned_text, length(c) as chars, lower(c) as low from (select doc_id, {clean('text')} as c from documents)",
    "clean_feedback": with_tables("select ord, id, source, rating, cleaned_text from cleaned", "cleaned"),
    "spam_flags": with_tables(f"select ord, {matches(f'lower({clean('text')})', rules.SPAM_PATTERNS)} as is_spam from feedback", "feedback"),
    "noise_flags": with_tables(f"select ord, {is_noise('lower(cleaned_text)')} as is_noise from cleaned", "cleaned"),
    "noise_filtered": with_tables("select ord, cleaned_text from filtered", "filtered"),
    "noise_fallback": with_tables("select ord, cleaned_text from flagged where is_noise", "flagged"),
    "event_times": "select doc_id, case when doc_id % 4 < 3 then strftime(timestamp '2024-01-01 00:00:00' + to_seconds(doc_id * 60), '%Y-%m-%d %H:%M:%S') end as event_ts from documents",
    "redacted_texts": f"select doc_id, {redact('text')} as redacted from documents",
    "paraphrases": with_tables(f"select ord, {paraphrase('cleaned_text')} as paraphrased from cleaned", "cleaned"),
    "cut_quotes": with_tables(
        "select ord, substring(cleaned_text, 1, 250) as long_quote, substring(cleaned_text, 1, 90) || '...' as short_quote from cleaned", "cleaned"),
    "word_counts": f"""select doc_id, {word_count("('## ' || replace(text, chr(10), chr(10) || '- '))")} as words from documents""",
    "list_items": f"""
        select doc_id, unnest(l) as item, generate_subscripts(l, 1) as place from
        (select doc_id, list_filter(list_transform(string_split(text, ','), lambda x: {strip('x')}), lambda x: x <> '') as l from documents)""",
    # ---------------------------------------------------------------- clusters
    "issue_domains": with_tables(
        "select ord, " + cases([(" or ".join(f"contains(lower(cleaned_text), {q(x)})" for x in ws), q(n)) for n, ws in rules.DOMAIN_WORDS],
                               q(rules.GENERAL_DOMAIN)) + " as sub_domain from cleaned", "cleaned"),
    "review_sentiment": with_tables(
        "select ord, rating, case when rating >= 4 then 'positive' when rating in (1, 2) then 'negative' when p > n then 'positive' "
        "when n > p then 'negative' when p > 0 then 'mixed' else 'neutral' end as sentiment from (select ord, rating, "
        "count(distinct w) filter (w in (" + ", ".join(q(x) for x in rules.POSITIVE_WORDS) + ")) as p, "
        "count(distinct w) filter (w in (" + ", ".join(q(x) for x in rules.NEGATIVE_WORDS) + ")) as n "
        "from (select ord, rating, unnest(string_split(lower(cleaned_text), ' ')) as w from cleaned) group by 1, 2)", "cleaned"),
    "cluster_assignment": with_tables("select ord, sub_domain, cluster_id from classified join cluster_ids using (sub_domain)", "cluster_ids"),
    "domain_prevalence": with_tables(
        "select cluster_id, sub_domain, n, total, array_to_string(list_sort(sources), ',') as sources, len(sources) as n_sources, prevalence_score from stats", "stats"),
    "cluster_sentiment": with_tables(
        "select sub_domain, n, negative_pct, positive_pct, neutral_pct, mixed_pct, dominant, summary, positive_pct > 30 and negative_pct > 30 as mixed_moods from stats", "stats"),
    "cluster_signal": with_tables(
        "select sub_domain, n, chars, cluster_ord, array_to_string(sources, ',') as sources, signal_strength_score from stats", "stats"),
    "cluster_samples": with_tables("select sub_domain, place, ord, cleaned_text from samples", "samples"),
    "frequent_keywords": with_tables(
        "select sub_domain, row_number() over (partition by sub_domain order by n desc, term) as place, term, n "
        "from (select sub_domain, term, count(*) as n from words group by all) qualify place <= 8", "words"),
    "cluster_keywords": with_tables(
        "select cluster_id, sub_domain, array_to_string(keywords, ',') as keywords from cluster_ids join keywords using (sub_domain)", "keywords"),
    "fallback_keywords": with_tables(
        "select sub_domain, " + q(",".join(rules.FALLBACK_KEYWORDS)) + " as keywords from cluster_ids", "cluster_ids"),
    "term_counts": with_tables("select * from terms", "terms"),
    "topic_words": with_tables(
        """, shared as (select term, count(*) as tf from grams group by 1 having count(distinct sub_domain) >= 2),
        per as (select g.sub_domain, g.term, count(*) as tf, any_value(t.tf) as f from grams g join shared t using (term) group by 1, 2),
        sizes as (select sub_domain, sum(tf) as size from per group by 1),
        scored as (select sub_domain, term, tf, cast(tf as double) / size * ln(1 + (select cast(trunc(avg(size)) as double) from sizes) / f) as score
                   from per join sizes using (sub_domain))
        select sub_domain, row_number() over (partition by sub_domain order by score desc, term) as place, term, tf, round(score, 6) as score
        from scored qualify place <= 8""", "grams"),
    # ---------------------------------------------------------------- extraction
    "rule_matches": with_tables("select ord, theme_id, label, class from matched", "matched"),
    "unclassified": with_tables("select ord, cleaned_text from tagged where len(theme_ids) = 0", "tagged"),
    "rule_summary": with_tables(
        f"""select theme_id, label, class, count, pct_of_substantive, rating_dist, row_number() over (partition by class order by count desc, rule_no) as place
        from ({_RULE_COUNTS}) join (select theme_id, string_agg(k || ':' || c, ',' order by k) as rating_dist from
          (select theme_id, coalesce(cast(cast(rating as int) as varchar), '') as k, count(*) as c from matched group by all) group by 1) using (theme_id)""", "matched"),
    "rule_quotes": with_tables(_RULE_QUOTES, "matched"),
    "unclassified_sample": with_tables(
        "select ord, cleaned_text from tagged where len(theme_ids) = 0 order by md5(ord || '|99'), ord limit 15", "tagged"),
    "extraction_meta": with_tables(
        "select count(*) as total_reviews, count(*) filter (length(cleaned_text) > 40) as substantive_reviews, "
        "count(*) filter (length(cleaned_text) <= 40) as short_noise_discarded, "
        + ", ".join(f"count(*) filter (source = {q(s)}) as {s}" for s in rules.SOURCE_RANK) + " from classified", "classified"),
    "extraction_document": with_tables(
        f"""select (select count(*) from classified) as total_reviews, (select count(*) from tagged) as substantive_reviews,
        (select count(*) from tagged where len(theme_ids) = 0) as unclassified_count, theme_id, class as classification, count,
        pct_of_substantive, sample_quotes from ({_RULE_COUNTS}) join
        (select theme_id, string_agg(quote, {q(LIST_SEP)} order by place) as sample_quotes from ({_RULE_QUOTES}) group by 1) using (theme_id)""", "matched"),
    # ---------------------------------------------------------------- labels
    "counter_evidence": with_tables(
        f"select sub_domain, primary_issue, {_ev_text} as contradictory_evidence, {_ev_n} as opposing from stats, "
        f"(values {', '.join(f'({q(i)})' for i in _EVIDENCE_ISSUES)}) as i(primary_issue)", "stats"),
    "evidence_quotes": with_tables(
        f"select doc_id, primary_issue, array_to_string({evidence_quotes('sample_quotes', 'primary_issue')}, {q(LIST_SEP)}) as quotes from proposals", "proposals"),
    "confidence": with_tables(
        f"select doc_id, {confidence('n', 'relevance')} as confidence, {confidence_text('n', 'relevance', 'sources', 'e0_n')} as confidence_explanation from proposals", "proposals"),
    "reasoning_traces": with_tables(
        f"select doc_id, theme_name, {trace('observed_facts', 'theme_name', 'relevance')} as reasoning_trace from proposals", "proposals"),
    "critic_rules": with_tables(f"select {_flat(CRITIC_COLUMNS)} from judged", "judged"),
    "heuristic_labels": with_tables(f"select cluster_id, {_flat(LABEL_COLUMNS)} from labels", "labels"),
    "label_prompts": with_tables(
        "select sub_domain, 'Keywords: ' || array_to_string(keywords[1:6], ', ') || chr(10) || 'Quotes:' || chr(10) || "
        "array_to_string(list_transform(sample_quotes[1:6], lambda x: '- ' || x), chr(10)) as prompt from sample_lists join keywords using (sub_domain)",
        "sample_lists", "keywords"),
    "question_prompts": with_tables(
        "select position, 'Theme: ' || theme || chr(10) || 'Primary Issue: ' || primary_issue || chr(10) || 'Relevance: ' || research_relevance || chr(10) "
        "|| 'Mechanism from Quotes: ' || behavioral_mechanism || chr(10) || 'Customer Quotes:' || chr(10) || "
        "array_to_string(list_transform(example_quotes, lambda x: '- ' || x), chr(10)) as prompt from themes", "themes"),
    "reply_parsing": with_tables(
        f"""select doc_id, case when doc_id % 5 in (1, 2) then 'Unclassified' else theme_name end as theme_name,
        case when doc_id % 5 in (1, 2) then 'Other' else primary_issue end as primary_issue,
        case when doc_id % 5 in (1, 2) then '' else array_to_string(observed_facts, {q(LIST_SEP)}) end as observed_facts from proposals""", "proposals"),
    # ---------------------------------------------------------------- scores
    "actions": with_tables(f"select doc_id, action, cast({action_rank('action')} as bigint) as rank from (select doc_id, {_PROPOSED_ACTION} as action from proposals)", "proposals"),
    "scored_themes": with_tables(f"select {_flat(THEME_COLUMNS)} from scored", "scored"),
    "themes_same_name": with_tables(f"select {_flat(THEME_COLUMNS)} from merged1", "merged1"),
    "theme_renames": with_tables(
        renamed("(select doc_id, theme_name as theme, relevance as research_relevance, 'given' as product_opportunity, 'given' as research_hypothesis from proposals)"), "proposals"),
    "themes_standing": with_tables(f"select {_flat(THEME_COLUMNS)} from merged2", "merged2"),
    "ranked_themes": with_tables("select position, theme, action, prevalence_score, signal_strength_score from ranked", "ranked"),
    "theme_insights": with_tables(
        insights(f"(select doc_id, theme_name as theme, primary_issue, relevance as research_relevance, out_of_scope_reason, {_PROPOSED_ACTION} as action from proposals)", ""), "proposals"),
    # ---------------------------------------------------------------- outputs
    "results_table": with_tables(f"select {', '.join(_result_column(t, n) for t, n in w.RESULT_COLUMNS)} from themes", "themes"),
    "results_metadata": with_tables(f"select * exclude (share), {_WARNING} as coverage_warning, {round1('share')} as play_store_pct from ({_META})", "themes"),
    "results_document": with_tables(f"select position, total, {_flat(RESULT_THEME.fieldNames())} from themes", "themes"),
    "markdown_report": with_tables(_MARKDOWN, "themes"),
    "chat_context": with_tables(_CONTEXT, "themes"),
    "last_messages": "select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn desc) as back from conversations qualify back <= 5",
    "ranked_search": """with w as (select doc_id, {0} as w from (select doc_id, text as cleaned_text from documents)),
        stats as (select count(*) as n, sum(coalesce(len(w), 0)) / count(*) as average from w),
        tf as (select doc_id, len(w) as size, unnest(w) as term from w), tfs as materialized (select doc_id, any_value(size) as size, term, count(*) as tf from tf group by doc_id, term),
        df as (select term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tfs, stats group by term),
        q as (select distinct conv_id, unnest({0}) as term from (select conv_id, text as cleaned_text from conversations
          qualify row_number() over (partition by conv_id order by turn desc) = 1)),
        scored as (select conv_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))), 9) as score
          from q join df using (term) join tfs using (term), stats group by conv_id, doc_id)
        select conv_id, row_number() over (partition by conv_id order by score desc, doc_id) as rank, doc_id, round(score, 6) as score
        from scored qualify rank <= 10""".format(_TOKENS),
    "last_query": "select * from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1",
    "bucket_counts": with_tables(f"select {_bucket('a')} as bucket, count(*) as n from (select {_PROPOSED_ACTION} as a from proposals) group by 1", "proposals"),
    "theme_search": with_tables(
        f"select doc_id, theme_name as theme, a as action from (select *, {_PROPOSED_ACTION} as a from proposals) where contains(a, 'Monitor') and "
        "(contains(lower(theme_name), 'refund') or contains(lower(primary_issue), 'refund') or contains(lower(a), 'refund') "
        "or len(list_filter(sample_quotes, lambda x: contains(lower(x), 'refund'))) > 0)", "proposals"),
    "theme_by_title": with_tables(f"select theme, position, frequency from themes where theme = {q(w.ASSORTMENT_THEME)}", "themes"),
    "theme_badges": with_tables(
        f"""select doc_id, prev / 5.0::double * 100 as prevalence_pct, sig / 5.0::double * 100 as signal_pct,
        case when contains(a, 'Promote') then 'badge-green' when contains(a, 'Monitor') then 'badge-yellow' when contains(a, 'Niche') then 'badge-blue'
             when contains(a, 'Out of Scope') then 'badge-red' else 'badge-gray' end as action_badge,
        case when contains(a, 'Promote') then {q(w.PROMOTE_LABEL)} else a end as action_label,
        case when relevance in ('DIRECT', 'YES') then 'badge-green' when relevance in ('INDIRECT', 'PARTIAL') then 'badge-yellow' else 'badge-gray' end as relevance_badge,
        replace(relevance, '_', ' ') as relevance_label from (select *, {_PROPOSED_ACTION} as a from proposals)""", "proposals"),
    "theme_policies": with_tables(_policies(), "proposals"),
    # ---------------------------------------------------------------- personal data
    "pii_findings": with_tables("select * from pii", "pii"),
    "pii_feedback": with_tables(
        ", fl as (select ord, unnest(l) as line_text, generate_subscripts(l, 1) as line from (select ord, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]') as l from feedback)) "
        + findings("fl", "ord"), "feedback"),
    "pii_gate": with_tables(f"{_GATE} from pii", "pii"),
    "redact_rescan": f"""with red as (select doc_id, unnest(l) as line_text, generate_subscripts(l, 1) as line from
        (select doc_id, string_split_regex({redact('text')}, '\\r\\n|[\\n\\r\\x0b\\x0c]') as l from documents)),
        found as ({findings('red', 'doc_id')}) {_GATE} from found""",
    # ---------------------------------------------------------------- weekly note
    "note_rows": with_tables(_NOTE_ROWS, "themes"),
    "weekly_note": _note("select * from note"),
    "note_gate": _note(
        ", nl as (select 0 as k, unnest(l) as line_text, generate_subscripts(l, 1) as line from (select string_split(markdown, chr(10)) as l from note)), "
        f"found as ({findings('nl', 'k')}) {_GATE} from found"),
    # ---------------------------------------------------------------- vectors
    "cluster_number": "select source, least(12, greatest(4, count(*) // 30)) as k from documents group by 1",
    "centroid_distances": _CENTROIDS,
    "exact_neighbours": """select vec_id, row_number() over (partition by vec_id order by cosine desc, neighbour) as rank, neighbour, round(cosine, 6) as cosine
        from (select q.vec_id, v.vec_id as neighbour, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as cosine
              from embeddings q join embeddings v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0)
        qualify rank <= 15""",
    "neighbour_recall": "select count_if(vec_id % 100 = 0) as queries, count_if(vec_id % 100 = 0) * 15 as neighbours, true as enough from embeddings",
    "mutual_forest": _FOREST,
    "word_pairs": with_tables(
        f""", lists as (select list_filter({_TOKENS}, lambda t: not list_contains({strings(rules.stop_words(DEFAULT))}, t)) as w from classified),
        placed as (select row_number() over () as row, w from lists), single as (select row, unnest(w) as t, generate_subscripts(w, 1) as i from placed),
        known as materialized (select t, count(*) as n from single group by t order by n desc, t limit 2000),
        leads as (select t, lead(t, k) over (partition by row, k order by i) as u from single, range(1, 5) as d(k)),
        pairs as materialized (select least(t, u) as a, greatest(t, u) as b, count(*) as n from leads
          where t in (select t from known) and u in (select t from known) group by all),
        both_ways as (select a, b, n from pairs union all select b, a, n from pairs where a <> b),
        of_word as materialized (select a as t, sum(n)::double as n from both_ways group by 1), total as (select sum(n) as n from of_word)
        select p.a, p.b, p.n, case when p.n * total.n / (x.n * y.n) > 1 then round(ln(p.n * total.n / (x.n * y.n)), 6) end as information
        from pairs p join of_word x on x.t = p.a join of_word y on y.t = p.b, total""", "classified"),
    "learnt_vectors": with_tables(
        "select ord, 1.0::double as length, 16::bigint as numbers from classified", "classified"),
    "unnumbered_sources": (
        "select * from (values ('play_store', 1), ('app_store', 2), ('reddit', 3)) as s(source, place), "
        "(select count(*) as n, count(*) as positions, true as after_the_last from documents)"),
    "english_rows": f"""select doc_id, round(case when len(w) > 0 then len(list_filter(w, lambda x: list_contains({_STOP}, x))) / len(w) else 0 end, 6) as english_share
        from (select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') as w from documents where lang = 'en')""",
    "noise_flags_raw": with_tables(f"select ord, {is_noise('lower(text)')} as is_noise from feedback", "feedback"),
    "noise_states": with_tables(
        f"select ord, case when {matches('t', rules.RESIDUAL_SPAM_PATTERNS)} then 'noise' when {matches('t', rules.BEHAVIOUR_PATTERNS)} = "
        f"{matches('t', rules.NOISE_PATTERNS)} then 'uncertain' when {matches('t', rules.NOISE_PATTERNS)} then 'noise' else 'keep' end as state "
        "from (select ord, lower(cleaned_text) as t from cleaned)", "cleaned"),
    "fuzzy_duplicates": with_tables(
        """, w as (select ord, string_split(lower(cleaned_text), ' ') as w from cleaned),
        sh as materialized (select ord, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from w),
        size as (select ord, count(*) as n from sh group by 1),
        pairs as (select a.ord as x, b.ord as y, count(*) as c from sh a join sh b on a.s = b.s and b.ord < a.ord group by 1, 2)
        select distinct x as ord from pairs join size p on p.ord = x join size q on q.ord = y where c >= 0.9::double * (p.n + q.n - c)""", "cleaned"),
    "spot_check": with_tables(
        "select sub_domain, ord, cleaned_text, row_number() over (partition by sub_domain order by md5(ord || '|42'), ord) as place "
        "from classified qualify place <= 10", "classified"),
    "percentile_prevalence": with_tables(
        """select sub_domain, n, round(r, 6) as percent_rank, case when r >= 0.9 and len(sources) >= 3 then 5.0::double when r <= 0.2 and len(sources) <= 1 then 1.0::double
        when r >= 0.7 then 4.0::double when r >= 0.4 then 3.0::double else 2.0::double end as percentile_score
        from (select *, percent_rank() over (order by n) as r from counts)""", "counts"),
    "rank_intervals": _INTERVALS,
    "range_scores": with_tables(
        f"""select cluster_id, sub_domain, n, total, array_to_string(sources, {q(LIST_SEP)}) as sources, summary, prevalence_score, signal_strength_score
        from stats""", "stats").replace("as sentiment from filtered", "as sentiment from filtered where ord % 60 between 10 and 29"),
    "rank_stability": with_tables(
        f""", kept as (select size, case when n >= size then sub_domain else {q(rules.GENERAL_DOMAIN)} end as sub_domain, cast(sum(n) as bigint) as n
          from counts, (values (10), (15), (25)) as s(size) group by all),
        ranked_kept as (select *, rank() over (partition by size order by n desc) as r from kept)
        select cast(k.size as bigint) as size, count(*) as clusters, cast(sum(k.n) as bigint) as reviews, round(corr(k.r, b.r), 6) as rank_correlation
        from ranked_kept k left join ranked_kept b on b.size = 10 and b.sub_domain = k.sub_domain group by k.size""", "counts"),
    "gate_documents": with_tables(
        f"""select doc_id, false as passed, count(*) as blockers_count, arg_min(type, o) as first_type, string_agg(match, {q(LIST_SEP)} order by o) as matches
        from (select *, row_number() over (partition by doc_id order by line, list_position({list(rules.PII_TYPES)}, type), place) as o from pii) group by doc_id""", "pii"),
    "note_json": _note(
        "select title, word_count, cast(250 as bigint) as max_words, r.no, r.id, r.headline, r.paraphrased, r.action, "
        "'2024-01-07T08:00:00Z' as generated_at, total from note, note_rows r"),
    "long_note": with_tables(
        f", note_rows as materialized (select * replace ('\"' || repeat('word ', 100) || '\"' as paraphrased) from ({_NOTE_ROWS})), note as materialized ({_NOTE}) select * from note", "themes"),
    "kmeans_check": "select least(12, greatest(4, count(*) // 30)) as k, count(*) as n, least(12, greatest(4, count(*) // 30)) as clusters, cast(0 as bigint) as not_nearest from embeddings",
    "tfidf_weights": with_tables(
        f""", tf as (select ord, term, count(*) as tf from (select ord, unnest({_TOKENS}) as term from classified) group by all),
        idf as (select term, ln(((select count(*) from classified) + 1) / (count(*) + 1)) as idf from tf group by 1),
        raw as (select ord, tf * idf as w from tf join idf using (term)),
        norms as (select ord, sqrt(sum(w * w)) as norm from raw group by 1)
        select ord, count(*) as terms, round(sum(case when norm > 0 then w * w / norm / norm else 0 end), 6) as squares,
          round(max(case when norm > 0 then w / norm else 0 end), 6) as largest from raw join norms using (ord) group by 1""", "classified"),
}
