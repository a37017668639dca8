"""Texts written into themes, reports and notes. All entries are fixed values; ``@BRAND@`` is the product's name."""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values: relevance and actions
DIRECT, INDIRECT, OUT = "DIRECT", "INDIRECT", "OUT_OF_SCOPE"
PROMOTE = "Promote to Suggested Research Question"
NICHE = "Niche but credible"
MONITOR = "Monitor (Loud but vague)"
DROP = "Drop from shortlist"
OUT_ACTION = "Out of Scope for Research Objective"
ACTION_ORDER = (PROMOTE, NICHE, MONITOR, DROP, OUT_ACTION)

# ---------------------------------------------------------------- fixed values: theme names
TRUST_THEME = "Low Trust in High-Value Purchases"
ASSORTMENT_THEME = "Assortment Gaps in Long-Tail Categories"
NICHE_THEME = "Limited Availability of Niche Products"
FEES_THEME = "Excessive Fees and Surge Charges"
TIMELINESS_THEME = "Inconsistent Delivery Timeliness"
PAYMENT_THEME = "Payment Uncertainty at Checkout"

# ---------------------------------------------------------------- fixed values: sentences of the critic
RELEVANCE_REASONS = {
    DIRECT: "Evidence explicitly links the issue to category exploration.",
    INDIRECT: "Plausible influence on experience, but causal link to category trial is not explicitly established.",
    OUT: "Relevant to general platform quality, but not to the category trial business objective.",
}
OUT_MECHANISM = "This operational issue has insufficient evidence linking it to category exploration."
OUT_TRACE = "Operational Issue -> Out of Scope for Category Discovery"
OUT_HYPOTHESIS = (
    "No research hypothesis generated. Current evidence suggests this issue may influence overall platform experience, "
    "but does not establish a credible link to category exploration."
)
INDIRECT_HYPOTHESIS = OUT_HYPOTHESIS + " Recommend validating through exploratory interviews."
OUT_REASON = (
    "This operational issue affects general experience but has insufficient evidence linking it to category exploration."
)
INDIRECT_MECHANISM = ("May contribute to general order hesitation: ",
                      " (Requires qualitative validation for category trial impact).")
INDIRECT_MECHANISM_STARTS = ("May contribute", "Could influence")
TRUST_OPPORTUNITY = "Increase customer confidence when purchasing high-value or unfamiliar products."
TRUST_HYPOTHESIS = (
    "If customers trust that high-value products can be returned without financial loss, they will be more willing to "
    "purchase electronics and premium non-grocery products."
)
ASSORTMENT_OPPORTUNITY = (
    "Increase customer confidence that desired products will be available when shopping across new categories."
)
ASSORTMENT_HYPOTHESIS = (
    "If customers feel confident that niche long-tail items are stocked reliably, they will be more willing to search "
    "and purchase from new product categories."
)
OTHER_DIRECT_OPPORTUNITY = (
    "Increase customer willingness to explore new product categories by mitigating perceived purchase risk."
)
OTHER_DIRECT_HYPOTHESIS = (
    "If customer confidence in product quality and fulfillment reliability is increased, then customers will be more "
    "willing to purchase from new product categories."
)
FEES_OPPORTUNITY = "Increase customer price transparency and cost predictability at checkout."
TIMELINESS_OPPORTUNITY = "Increase customer confidence in delivery window predictability."
PAYMENT_OPPORTUNITY = "Ensure predictable checkout payment options."
GENERAL_OPPORTUNITY = "Increase customer confidence across general platform interactions."

# ---------------------------------------------------------------- fixed values: reasoning traces
FIRST_FACT = "Observed Friction"
# (words in the theme, steps after the first fact); no hit takes the last entry
TRACES = (
    (("high-value", "trust", "refund"),
     " ↓ Post-Purchase Return Risk ↓ High Financial Downside Fear ↓ Avoid Electronics & Non-Grocery Items"
     " ↓ Reduced Category Exploration"),
    (("assortment", "availability", "niche"),
     " ↓ Search Result Abandonment ↓ Perception of Grocery-Only Inventory ↓ Stop Evaluating Non-Staple Items"
     " ↓ Reduced Category Trial"),
    (("payment", "cod"),
     " ↓ Checkout Payment Option Friction ↓ Friction During First Non-Grocery Purchase ↓ Abandon Cart at Checkout"
     " ↓ Reduced Category Trial"),
    (("fee", "surge"),
     " ↓ Added Transaction Cost ↓ General Order Margin Friction ↓ Potential Impact on Basket Building"
     " ↓ Category Trial Indirect Impact"),
    (("delivery", "time"),
     " ↓ Fulfillment Speed Variance ↓ Unpredictable Delivery Windows ↓ General Platform Order Hesitation"
     " ↓ Category Trial Indirect Impact"),
)
OTHER_TRACE = (
    " ↓ Perceived Transaction Friction ↓ Elevated Trial Hesitation ↓ Stick to Baseline Grocery Habits"
    " ↓ Reduced Category Exploration"
)

# ---------------------------------------------------------------- fixed values: confidence
HIGH_COUNT, MEDIUM_COUNT = 80, 30
DEFAULT_SOURCE_COUNT, DEFAULT_SOURCES = 2, "Play Store, App Store"
# %1$s sources counted, %2$s sources named, %3$s reviews, %4$s opposing reviews
CONFIDENCE = {
    "High": (
        "High confidence because:\n"
        "- Observed consistently across %1$s sources (%2$s).\n"
        "- %3$s supporting customer reviews describe the same behavioral mechanism using consistent language.\n"
        "- Pure cluster representing one clear customer problem.\n"
        "- Contradictory evidence check: %4$s opposing reviews identified in dataset."
    ),
    "Medium": (
        "Medium confidence because:\n"
        "- Observed across %1$s sources (%2$s) in %3$s customer reviews.\n"
        "- Cluster represents a specific customer problem with moderate signal strength.\n"
        "- Contradictory evidence check: %4$s opposing reviews identified in dataset.\n"
        "- Requires qualitative user interview validation for broader category trial impact."
    ),
    "Low": (
        "Low confidence because:\n"
        "- Derived from a small sample of %3$s customer reviews.\n"
        "- Requires primary qualitative interview screener validation to confirm behavioral impact."
    ),
}

# ---------------------------------------------------------------- fixed values: counter-evidence sentences
# text between the count and the quote, text after the quote
EVIDENCE_LEAD = "Contradictory evidence identified in dataset: "
EVIDENCE_TEXT = {
    "payment": " reviews report smooth checkout or successful COD/UPI payments (e.g. ",
    "delivery": " reviews report positive, fast delivery experiences (e.g. ",
    "quality": " reviews report positive product quality or satisfactory support (e.g. ",
    "price": " reviews express satisfaction with pricing or offers (e.g. ",
}
EVIDENCE_TAIL = {
    "payment": ").",
    "delivery": "). This indicates delivery friction is localized rather than platform-wide.",
    "quality": ").",
    "price": ").",
}
EVIDENCE_CHARS = 90
# the count of reviews in this sentence is part of the format
NO_EVIDENCE = ("No contradictory evidence was found after explicitly reviewing all ", " dataset reviews.")

# ---------------------------------------------------------------- fixed values: heuristic labels
# key -> words that choose it, in order; the last key has no words
LABEL_WORDS = (
    ("trust", ("refund", "return", "defective", "replace")),
    ("assortment", ("book", "constitution", "out of stock", "search")),
)
DEFAULT_LABEL = "service"
LABELS = {
    "trust": dict(
        theme_name=TRUST_THEME,
        primary_issue="Refunds / Returns",
        evidence_summary="Customers reported denied return requests on non-grocery items and missing refund protection.",
        observed_facts=["Return request rejected on non-working earphone",
                        "No refund given for defective non-grocery product"],
        observed_behavior="Users restrict purchases to low-risk grocery staples and avoid unfamiliar non-grocery categories.",
        behavioral_mechanism="The perceived financial downside of a failed purchase outweighs the expected utility of trying a new category.",
        underlying_need="Financial safety and guaranteed post-purchase protection.",
        barrier_or_driver="Weak trust in post-purchase refund policies for non-staple categories.",
        business_impact="High",
        signal_strength="High",
        customer_journey_stage="Evaluation",
        alternative_explanations=["Users prefer specialist e-commerce platforms for electronics."],
        research_questions=["Tell me about the last time you decided not to buy a product outside your usual categories on @BRAND@.",
                            "What specific return assurances did you look for before deciding?"],
        why_these_quotes_matter="Quotes explicitly state customer hesitation to risk money on non-perishable goods due to rejected refunds.",
        assumptions=["Reviews reflect actual purchasing hesitation."],
        out_of_scope_reason="",
    ),
    "assortment": dict(
        theme_name=ASSORTMENT_THEME,
        primary_issue="Assortment",
        evidence_summary="Customers reported unavailability of specific long-tail non-grocery products upon searching.",
        observed_facts=["Requested long-tail non-grocery product was unavailable", "Search yields out-of-stock results"],
        observed_behavior="Users assume non-grocery categories are limited and stop searching.",
        behavioral_mechanism="Perceived friction in finding specific non-grocery items leads customers to assume @BRAND@ only carries daily essentials.",
        underlying_need="Deep assortment availability for non-staple goods.",
        barrier_or_driver="Perceived lack of product depth in non-grocery categories.",
        business_impact="High",
        signal_strength="Medium",
        customer_journey_stage="Discovery",
        alternative_explanations=["Customers prefer specialist book/electronics retailers."],
        research_questions=["When searching for products outside groceries on @BRAND@, how do you evaluate whether the selection is adequate?"],
        why_these_quotes_matter="Quotes demonstrate search abandonment due to perceived long-tail assortment gaps.",
        assumptions=[],
        out_of_scope_reason="",
    ),
    "service": dict(
        theme_name="General Service Delivery Feedback",
        primary_issue="Delivery Experience",
        evidence_summary="Operational feedback regarding delivery speed and staff behavior.",
        observed_facts=["Delivery partner arrived in 15 minutes"],
        observed_behavior="General feedback on delivery service.",
        behavioral_mechanism=OUT_MECHANISM,
        underlying_need="Fast and reliable delivery.",
        barrier_or_driver="Operational logistics performance.",
        business_impact="Low",
        signal_strength="Low",
        customer_journey_stage="Fulfillment",
        alternative_explanations=[],
        research_questions=[],
        why_these_quotes_matter="Operational delivery feedback without direct category trial mechanism.",
        assumptions=[],
        out_of_scope_reason=OUT_REASON,
    ),
}
LABEL_ARRAYS = ("observed_facts", "alternative_explanations", "research_questions", "assumptions")

# ---------------------------------------------------------------- fixed values: defaults for missing fields
FIELD_DEFAULTS = {
    "theme_name": "Unclassified",
    "primary_issue": "Other",
    "research_relevance": OUT,
    "evidence_summary": "",
    "observed_behavior": "",
    "behavioral_mechanism": "",
    "underlying_need": "",
    "barrier_or_driver": "",
    "business_impact": "None",
    "confidence": "Medium",
    "confidence_explanation": "",
    "signal_strength": "Medium",
    "customer_journey_stage": "Evaluation",
    "contradictory_evidence": "",
    "product_opportunity": "",
    "research_hypothesis": "",
    "why_these_quotes_matter": "",
    "reasoning_trace": "",
    "out_of_scope_reason": "",
}

# ---------------------------------------------------------------- fixed values: insight and question
INSIGHT_WORDS = ("Refund", "Return", "Risk")
RISK_INSIGHT = (
    "If customers trust that post-purchase refund issues will be resolved fairly, they will be more willing to purchase "
    "from unfamiliar or higher-risk product categories."
)
RISK_QUESTION = (
    "Tell me about the last time you considered buying a product outside your usual categories on @BRAND@—what specific "
    "return assurances did you look for before deciding?"
)
GENERAL_INSIGHT = OTHER_DIRECT_HYPOTHESIS
GENERAL_QUESTION = (
    "Walk me through your decision process when considering purchases outside your regular order list."
)
OUT_REASON_FORMAT = ("This theme represents operational feedback in ",
                     " without a direct causal link to category exploration.")

# ---------------------------------------------------------------- fixed values: weekly note
NOTE_ACTIONS = {
    "Refunds / Returns": "Refactor instant-refund triggers and optimize post-purchase support flows for high-value purchases.",
    "Assortment": "Run target category expansions for long-tail non-grocery goods and optimize search matching depth.",
    "Delivery Experience": "Optimize delivery routing mechanisms to mitigate surge pricing and delivery fee spikes.",
    "Pricing": "Optimize promotional coupon validations to prevent checkout cart errors and transaction failures.",
}
NOTE_ACTION_DEFAULT = ("Audit feedback and optimize experience in ", " category.")
NOTE_TITLE = "@BRAND@ — Weekly Customer Discovery Pulse "
NOTE_THEMES = 3
NOTE_MAX_WORDS = 250
NOTE_SHORT_CHARS = 60
NOTE_QUOTE_CHARS = 100
NOTE_QUOTE_DEFAULT = "Friction reported by customer in this category."
NOTE_HEADINGS = ("## Top Customer Opportunities", "## Representative Customer Evidence", "## Proposed Action Items")
NOTE_DEFAULTS = dict(theme="Uncategorized Opportunity", prevalence=5.0, signal=4.5, mentions=50, issue="General UX")

# ---------------------------------------------------------------- fixed values: results table
RESULT_COLUMNS = (
    ("Theme", "theme"), ("Primary Issue", "primary_issue"), ("Research Relevance", "research_relevance"),
    ("Evidence Summary", "evidence_summary"), ("Observed Facts", "observed_facts"),
    ("Observed Behavior", "observed_behavior"), ("Behavioral Mechanism", "behavioral_mechanism"),
    ("Underlying Need / JTBD", "underlying_need"), ("Barrier / Driver", "barrier_or_driver"),
    ("Business Impact", "business_impact"), ("Confidence", "confidence"),
    ("Confidence Explanation", "confidence_explanation"), ("Signal Strength", "signal_strength"),
    ("Customer Journey Stage", "customer_journey_stage"), ("Alternative Explanations", "alternative_explanations"),
    ("Contradictory Evidence", "contradictory_evidence"), ("Product Opportunity", "product_opportunity"),
    ("Research Hypothesis", "research_hypothesis"), ("Research Questions", "research_questions"),
    ("Why These Quotes Matter", "why_these_quotes_matter"), ("Assumptions", "assumptions"),
    ("Reasoning Trace", "reasoning_trace"), ("Prevalence Score (1-5)", "prevalence_score"),
    ("Mention Count", "frequency"), ("Sources", "sources"), ("Example Quote 1", "example_quotes"),
    ("Example Quote 2", "example_quotes"), ("Example Quote 3", "example_quotes"), ("Action / Priority", "action"),
    ("Out of Scope Reason", "out_of_scope_reason"),
)
COVERAGE_LIMIT = 70
COVERAGE_WARNING = (
    "Coverage Warning: Dataset is dominated by Google Play Store (",
    "%); deep qualitative community sources (Reddit) are underrepresented.",
)

# ---------------------------------------------------------------- fixed values: dashboard
# text in the action -> (bucket, badge)
ACTION_BADGES = (
    ("Promote", "badge-green"), ("Monitor", "badge-yellow"), ("Niche", "badge-blue"), ("Out of Scope", "badge-red"),
)
OTHER_BADGE = "badge-gray"
PROMOTE_LABEL = "Recommended for Primary Research"
RELEVANCE_BADGES = (("DIRECT", "YES"), "badge-green"), (("INDIRECT", "PARTIAL"), "badge-yellow")
# name, status, value, source
TRUST_POLICIES = (
    ("Brand Trust", "Enabled", "Verified sellers", None),
    ("Minimum Rating", "Enabled", "4.2+", "Recurring product quality complaints"),
    ("Complaint Screening", "Enabled", "Low tolerance", "Product damage and defect reports"),
)
DELIVERY_POLICY = ("Delivery Reliability", "Enabled", "Score visible", "Delivery complaint patterns")
PAYMENT_POLICY = ("Price Transparency", "Required", None, "Hidden charge complaints")
STANDING_POLICIES = (
    ("Explainability", "Required", None, "Platform-wide policy"),
    ("Social Proof", "Enabled", "Rating + review count", "Trust erosion pattern in reviews"),
    ("Confidence Threshold", "Required", "≥ 0.82", "Silence > irrelevant recommendation"),
)
MAX_POLICIES = 6


def branded(text: str, brand: str) -> str:
    return text.replace("@BRAND@", brand)


class Field(str):
    """The name of a theme column inside a line of a report."""


class Listed(Field):
    """A list column, joined by commas."""


class Quoted(Field):
    """A list column, every item in quotation marks, joined by commas."""


# ---------------------------------------------------------------- fixed values: lines of the Markdown report
REPORT_TITLE = (
    "# AI Product Discovery Engine — Master Knowledge Report\n",
    "**Business Objective**: *Increase percentage of Monthly Active Customers purchasing from at least one new category every month.*\n\n",
)
REPORT_TOTAL = (
    "**Total Feedback Analyzed**: ", Field("meta.total_feedback_analyzed"), " clean customer items across Play Store, App Store, and Reddit.\n",
)
REPORT_WARNING = ("⚠️ **", Field("meta.coverage_warning"), "**\n\n")
REPORT_HEADINGS = (
    "## 🎯 Promoted Product Opportunities & Auditable Reasoning Chains\n",
    "\n## 📊 Secondary / Monitored Signals\n",
    "\n## 🛑 Out of Scope Themes (Routed to Operational Product Teams)\n",
)
REPORT_NO_PROMOTED = "_No themes met the dual High Category Impact + High Signal Strength threshold._\n"
REPORT_NO_ASIDE = "_None_\n"
REPORT_PROMOTED = (
    ("### ", Field("no"), ". ", Field("theme"), "\n"),
    ("- **Primary Issue**: `", Field("primary_issue"), "` | **Relevance**: `", Field("research_relevance"), "` | **Journey Stage**: `",
     Field("customer_journey_stage"), "`\n"),
    ("- **Business Impact**: `", Field("business_impact"), "` | **Confidence**: `", Field("confidence"), "` (", Field("confidence_explanation"), ")\n"),
    ("- **Evidence Summary**: ", Field("evidence_summary"), "\n"),
    ("- **Observed Facts**: ", Listed("observed_facts"), "\n"),
    ("- **Observed Behavior (WHAT)**: ", Field("observed_behavior"), "\n"),
    ('- **Behavioral Mechanism (WHY)**: *"', Field("behavioral_mechanism"), '"*\n'),
    ("- **Underlying Need / JTBD**: ", Field("underlying_need"), "\n"),
    ("- **Barrier / Driver**: ", Field("barrier_or_driver"), "\n"),
    ('- **Product Opportunity (Solution-Agnostic)**: 🚀 **"', Field("product_opportunity"), '"**\n'),
    ('- **Research Hypothesis**: 🧪 *"', Field("research_hypothesis"), '"*\n'),
    ("- **Research Questions**: ", Quoted("research_questions"), "\n"),
    ("- **Alternative Explanations**: ", Listed("alternative_explanations"), "\n"),
    ("- **Contradictory Evidence**: ", Field("contradictory_evidence"), "\n"),
    ("- **Assumptions**: ", Listed("assumptions"), "\n"),
    ("- **Full Reasoning Trace**: `", Field("reasoning_trace"), "`\n"),
    ("- **Supporting Verbatim Customer Evidence**:\n",),
)
REPORT_QUOTE = ('  > "', '"\n')
REPORT_RULE = ("\n---\n",)
REPORT_WATCHED = (
    "- **", Field("theme"), "** (`", Field("primary_issue"), "`) — Stage: ", Field("customer_journey_stage"), " | Impact: ",
    Field("business_impact"), " | Confidence: ", Field("confidence"), "\n",
)
REPORT_ASIDE = (
    ("### 📌 ", Field("theme"), "\n"),
    ("- **Primary Area**: `", Field("primary_issue"), "` | **Journey Stage**: `", Field("customer_journey_stage"), "` | **Mentions**: ",
     Field("frequency"), "\n"),
    ("- **Out of Scope Rationale**: ", Field("out_of_scope_reason"), "\n"),
    ("- **Sample Quote**:\n",),
)

# ---------------------------------------------------------------- fixed values: lines of the chat context
CONTEXT_TITLE = ("=== ", " CUSTOMER FEEDBACK CORPUS CONTEXT ===")
CONTEXT_HEAD = (
    ("Total Feedback Analyzed: ", Field("meta.total_feedback_analyzed"), " clean items"),
    ("Total Unique Themes: ", Field("meta.total_themes_discovered")),
    ("Promoted Interview Hypotheses: ", Field("meta.promoted_research_questions_count")),
    ("Out of Scope Themes: ", Field("meta.out_of_scope_themes_count"), "\n"),
    ("--- DISCOVERED THEMES & BEHAVIORAL MECHANISMS ---",),
)
CONTEXT_THEME = (
    ('\nTheme: "', Field("theme"), '"'),
    ("  Primary Area: ", Field("primary_issue")),
    ("  Relevance: ", Field("research_relevance")),
    ("  Journey Stage: ", Field("customer_journey_stage")),
    ("  Observed Facts: ", Listed("observed_facts")),
    ("  Observed Behavior: ", Field("observed_behavior")),
    ("  Behavioral Mechanism: ", Field("behavioral_mechanism")),
    ("  Underlying Need / JTBD: ", Field("underlying_need")),
    ("  Barrier / Driver: ", Field("barrier_or_driver")),
    ("  Business Impact: ", Field("business_impact"), " | Confidence: ", Field("confidence")),
    ("  Product Opportunity: ", Field("product_opportunity")),
    ("  Research Question: ", Field("suggested_research_question")),
    ("  Action / Priority: ", Field("action")),
)
CONTEXT_REASON = ("  Out of Scope Reason: ", Field("out_of_scope_reason"))
CONTEXT_QUOTES = "  Customer Quotes:"
CONTEXT_QUOTE = ('    - "', '"')
