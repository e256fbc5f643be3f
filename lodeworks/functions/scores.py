"""Scores of atoms, evidence, authority and documents as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Weights, word lists and patterns of the scores.
FUNCTION_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "can",
    "could", "shall", "should", "may", "might", "must", "of", "in", "to", "for", "with", "on", "at", "from", "by", "about", "as", "into",
    "like", "through", "after", "over", "between", "out", "against", "during", "without", "before", "under", "around", "and", "but", "or",
    "nor", "not", "so", "yet", "both", "either", "neither", "each", "every", "all", "any", "few", "more", "most", "other", "some", "such",
    "than", "too", "very", "just", "also", "that", "which", "who", "whom", "whose", "what", "where", "when", "why", "how", "if", "because",
    "while", "although", "it", "its", "this", "these", "those", "i", "you", "he", "she", "we", "they", "me", "him", "her", "us", "them",
    "my", "your", "his", "our", "their", "mine", "yours",
]
ATOM_WEIGHTS = {"clarity": 0.22, "factual_density": 0.18, "technical_specificity": 0.20, "qualifier_quality": 0.15, "scope_specificity": 0.15, "evidence_traceability": 0.10}
ACCEPT, REPAIR = 0.50, 0.25
MEASURE = r"(?i)[0-9]+\.?[0-9]*\s*(percent|%|ms|gb|mb|tb|params|layers|epochs|accuracy|error|loss|score)"
TECHNICAL = (
    r"\b[A-Z][A-Za-z]*(Net|Model|Layer|Method|Algorithm|System|Framework)\b|\b(Accuracy|Precision|Recall|F1|Loss|Error|Throughput|Latency|Params)\b"
    r"|\b(Transformer|CNN|RNN|LSTM|GRU|GAN|BERT|GPT|ResNet|VGG|Attention)\b|\b(PyTorch|TensorFlow|JAX|NumPy|SciPy|Pandas)\b"
)
COMPARATIVE = r"(?i)\b(more|less|better|worse|higher|lower|faster|slower|improved|decreased)\b"
#: Found where ``v1.2.3`` is, since ``v1`` is: a repeated group would take a stack frame for each repetition.
VERSION = r"(?i)\bv[0-9]+\b"
TECH_NOUN = r"(?i)\b(api|protocol|kernel|latency|throughput|runtime|allocator|index|cache|model|dataset)\b"
TECH_NAME = r"(?i)\b(docker|kubernetes|postgres|redis|pytorch|tensorflow|cuda|linux|windows)\b"
QUALIFIER = r"(?i)\b(only|unless|except|when|if|under|without|with|typically|generally|often|rarely|may|can|must|should|not|never|always)\b"
SCOPE_WORD = r"(?i)\b(on|in|for|during|before|after|between|within)\b"
SCOPE_PLACE = r"(?i)\b(prod|production|staging|test|linux|windows|macos|browser|server|client|database)\b"
SCOPE_TIME = r"(?i)\b(version|release|build|epoch|quarter|year|today|current|previous)\b"
CAUSE = r"(?i)\b(because|therefore|due to|caused by|measured|observed)\b"
METRIC = r"(?i)(percent|%|ms|gb|mb|tb|params|layers|epochs|accuracy|error|loss|score|flops|f1)"
NAMED = r"\b[A-Z][a-z]{2,}(Net|Model|Layer|Method|Algorithm|System|Framework|Transformer|CNN|RNN|LSTM|GAN|BERT|GPT|ResNet|VGG)\b"
CAUSAL_TERMS = ["causes", "enables", "prevents", "reduces", "improves", "achieves", "produces", "generates", "determines", "requires"]
COMPARATIVE_TERMS = ["better", "worse", "higher", "lower", "faster", "slower", "more", "less", "superior", "inferior", "outperforms"]
TRUST_STATES = ["contested", "forming", "reusable", "stale", "synthesized"]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def hits(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def when(test: Column, value: float) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0.0))


def clarity(content: Column) -> Column:
    """Ending, verb, length and share of capitals."""
    ended = F.rtrim(content)
    closed = ended.rlike(r"[.!?]$") | (ended.rlike(r"[^ \t\n][)\]\">°%]$") & (F.length(ended) > 2))
    letters = F.length(F.regexp_replace(content, r"[^A-Za-zÀ-ÖØ-öø-ÿŒœ]+", ""))
    capitals = F.length(F.regexp_replace(content, r"[^A-ZÀ-ÖØ-ÞŒ]+", ""))
    # Branches would evaluate the counts anew each.
    length = T.let(T.word_count(content), lambda n: F.when(n.between(8, 50), 0.15).when(n.between(5, 7), 0.08).when(n > 50, 0.03).otherwise(0.0))
    share = T.let(letters, lambda n: F.when(n > 0, capitals / n))
    cased = T.let(share, lambda x: F.when(x.between(0.03, 0.25), 0.15).when(x.between(0.01, 0.40), 0.08).otherwise(0.0))
    score = when(closed, 0.35) + when(T.has_verb(content, T.SCORING_VERBS), 0.35) + length + cased
    return F.when(F.length(content) < 5, 0.0).otherwise(F.least(score, F.lit(1.0)))


def factual_density(content: Column) -> Column:
    """Share of content words, lifted by measurements, names, compounds and quotations."""
    w = F.transform(T.words(content), lambda x: F.btrim(F.lower(x), F.lit(".,;:!?()\"'")))
    own = lambda w: F.size(F.filter(w, lambda x: (x != "") & ~x.isin(FUNCTION_WORDS)))
    quotes = (T.occurrences(content, '"') >= 2) | (T.occurrences(content, "'") >= 2)
    # Two words of a name tell as much as all of them, without a stack frame for each.
    lift = (
        when(content.rlike(MEASURE), 0.2) + when(content.rlike(r"[A-Z][a-z]+\s+[A-Z][a-z]+"), 0.15) + when(content.rlike(r"[a-z]+[A-Z]|[a-z]+-[a-z]+"), 0.1) + when(quotes, 0.05)
    )
    return T.let(w, lambda w: F.when((F.length(content) < 10) | (F.size(w) == 0), 0.0).otherwise(F.least(own(w) / F.size(w) * 0.6 + lift, F.lit(1.0))))


def citation_likelihood(content: Column) -> Column:
    proper = T.let(hits(content, r"\b[A-Z][a-z]{2,}\b"), lambda n: F.when(n >= 2, 0.15).when(n == 1, 0.08).otherwise(0.0))
    score = (
        F.least(hits(content, r"[0-9]+\.?[0-9]*") * 0.1, F.lit(0.3)) + when(content.rlike(TECHNICAL), 0.15) + when(content.rlike(r"v?[0-9]+\.[0-9]+|\b(20[0-9]{2}|19[0-9]{2})\b"), 0.1)
        + proper + when(content.rlike(COMPARATIVE), 0.1)
    )
    return F.when(F.length(content) < 10, 0.0).otherwise(F.least(score, F.lit(1.0)))


def technical_specificity(content: Column) -> Column:
    return F.least(when(content.rlike(VERSION), 0.2) + when(content.rlike(TECH_NOUN), 0.35) + when(content.rlike(TECH_NAME), 0.25) + when(content.rlike("[0-9]"), 0.2), F.lit(1.0))


def qualifier_quality(content: Column) -> Column:
    return T.let(hits(content, QUALIFIER), lambda n: F.when(n == 0, 0.4).otherwise(F.least(n * 0.08 + 0.5, F.lit(1.0))))


def scope_specificity(content: Column) -> Column:
    return F.least(when(content.rlike(SCOPE_WORD), 0.35) + when(content.rlike(SCOPE_PLACE), 0.35) + when(content.rlike(SCOPE_TIME), 0.30), F.lit(1.0))


def evidence_traceability(content: Column) -> Column:
    return F.least(F.greatest(citation_likelihood(content), when(content.rlike(CAUSE), 0.35)), F.lit(1.0))


def redundancy(signature: Column, seen: Column) -> Column:
    """1 for content unlike all seen before, 0 for a repeat: the square of one less the Jaccard similarity."""
    return F.when(F.size(seen) == 0, 1.0).otherwise(F.pow(1 - T.jaccard(signature, seen), F.lit(2.0)))


def atom_score(content: Column, unique: Column | None = None) -> Column:
    """A struct of all six scores, the weighted score and the verdict; ``unique`` is the redundancy score, 1 by default."""
    parts = {
        "clarity": clarity(content), "factual_density": factual_density(content), "technical_specificity": technical_specificity(content),
        "qualifier_quality": qualifier_quality(content), "scope_specificity": scope_specificity(content), "evidence_traceability": evidence_traceability(content),
    }
    unique = F.lit(1.0) if unique is None else unique

    def finish(p: Column) -> Column:
        total = sum((p[k] * w for k, w in ATOM_WEIGHTS.items()), F.lit(0.0))
        empty = (T.word_count(content) < 5) | ~content.rlike("[A-Za-z]")
        fluff = content.rlike(r"(?i)\b(great|amazing|interesting|important)\b") & (p["factual_density"] < 0.3)
        bad = empty | fluff | (unique < 0.1) | ~T.has_verb(content, T.SCORING_VERBS)
        verdict = F.when(bad, "reject").when(total >= ACCEPT, "accept").when(total >= REPAIR, "repair").otherwise("reject")
        return F.struct(F.round(total + 1e-9, 3).alias("score"), *[F.round(p[k], 3).alias(k) for k in ATOM_WEIGHTS], F.round(unique, 3).alias("redundancy"), verdict.alias("verdict"))

    return F.element_at(F.transform(F.array(F.struct(*[c.alias(k) for k, c in parts.items()])), finish), 1)


def importance(content: Column) -> Column:
    low = F.lower(content)
    score = (
        F.least(hits(content, r"[0-9]+\.?[0-9]*") * 0.05, F.lit(0.15)) + F.least(hits(content, METRIC) * 0.08, F.lit(0.20)) + F.least(hits(content, NAMED) * 0.10, F.lit(0.25))
        + when(low.rlike("|".join(CAUSAL_TERMS)), 0.20) + when(low.rlike("|".join(COMPARATIVE_TERMS)), 0.15)
    )
    return F.when(F.length(content) < 10, 0.1).otherwise(clamp(score, 0.1))


def confidence(source_type: Column, corroborations: Column, quality: Column) -> Column:
    """A fifth of the source's reliability, up to .2 for corroborations, a tenth of the quality; three places."""
    source = F.when(source_type == "academic", 0.9).when(source_type == "standard", 0.6).when(source_type == "skip", 0.0).otherwise(0.5)
    return clamp(F.round(source * 0.20 + F.least(corroborations * 0.05, F.lit(0.20)) + quality * 0.10, 3))


def url_authority(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.rlike(r"arxiv|nature\.com|science\.org|ncbi\.nlm\.nih\.gov|ieeexplore"), 1.0).when(low.rlike(r"github\.com|wikipedia\.org|docs\.|\.edu"), 0.8).otherwise(0.5)


def document_priority(novelty: Column, authority: Column, length: Column, gap: Column, threshold: float = 0.3) -> Column:
    return F.when(novelty < threshold, 0.0).otherwise(novelty * 0.35 + authority * 0.25 + F.least(length / 5000, F.lit(1.0)) * 0.20 + gap * 0.20)


def evidence_weight(reliability: Column, centrality: Column, specificity: Column, recency: Column, relevance: Column, contradictory: Column) -> Column:
    fresh = F.when(F.coalesce(recency, F.lit(0.0)) == 0, 0.5).otherwise(recency)
    base = clamp(reliability * 0.6 + centrality * 0.4) * 0.30 + specificity * 0.20 + fresh * 0.20 + F.log1p(centrality) / F.log1p(F.lit(2.0)) * 0.15 + relevance * 0.15
    return clamp(F.when(contradictory, base * 0.7).otherwise(base))


def query_relevance(content: Column, terms: Column) -> Column:
    """Share of the terms contained in the content; .5 without terms."""
    low = F.lower(content)
    return F.when(F.size(terms) == 0, 0.5).otherwise(F.size(F.filter(terms, lambda t: low.contains(t))) / F.size(terms))


def retrieval_fusion(similarity: Column, authority: Column, activation: Column, context: Column) -> Column:
    return clamp(similarity * 0.40 + authority * 0.35 + F.least(activation / 10, F.lit(1.0)) * 0.15 + context * 0.10)


def activation_decay(activation: Column, hours: Column, rate: float = 0.01) -> Column:
    return activation * F.exp(hours * -rate)


def authority_score(support: Column, confidence: Column, days: Column, contradictions: Column) -> Column:
    balance = F.when(contradictions == 0, 1.0).when(contradictions <= support, 0.5).otherwise(0.2)
    return F.least(F.log1p(support) * 0.4 + confidence * 0.3 + F.exp(-days / 45) * 0.1 + balance * 0.2, F.lit(1.0))


def stability_score(authority: Column, contradictions: Column, support: Column, days: Column) -> Column:
    return clamp(authority - contradictions * 0.3 + F.log1p(support) * 0.2 - (1 - F.exp(-days / 90)))


def anchor_authority(domains: Column, beliefs: Column, shared: Column) -> Column:
    return F.least(domains / 5, F.lit(1.0)) * 0.3 + F.least(beliefs / 20, F.lit(1.0)) * 0.3 + F.when(shared, 0.4).otherwise(0.4 * 0.3)


def retention(importance: Column, days: Column, decay: float, accesses: Column) -> Column:
    return importance * 0.6 + F.greatest(1 - days * decay, F.lit(0.0)) * 0.3 + F.least(accesses / 10, F.lit(1.0)) * 0.1


def trust_state(
    explicit: Column, freshness: Column, maturity: Column, contradictions: Column, applications: Column, objections: Column, ready: Column,
) -> Column:
    """stale over contested over reusable over synthesized over forming, unless a valid state is given."""
    contested = (F.lower(maturity) == "contested") | (F.coalesce(contradictions, F.lit(0)) > 0) | F.coalesce(objections, F.lit(False))
    reusable = F.coalesce(ready, F.lit(False)) | (F.coalesce(applications, F.lit(0)) > 0)
    return (
        F.when(explicit.isin(TRUST_STATES), explicit).when(F.lower(freshness) == "stale", "stale").when(F.coalesce(contested, F.lit(False)), "contested")
        .when(reusable, "reusable").when(F.lower(maturity).isin("synthesized", "matured"), "synthesized").otherwise("forming")
    )


def aggregate_trust_state(states: Column) -> Column:
    """One state of a set: contested and stale win, then reusable, then synthesized."""
    out = F.lit("forming")
    for state in ("synthesized", "reusable", "stale", "contested"):
        out = F.when(F.array_contains(states, state), state).otherwise(out)
    return out


@dataclass(frozen=True)
class RankingWeights:
    """Weights of the composite ranking; callers may pass their own."""

    relevance: float = 0.35
    trust: float = 0.20
    recency: float = 0.06
    density: float = 0.15
    proximity: float = 0.19
    density_again: float = 0.05


def composite(relevance: Column, trust: Column, days: Column, density: Column, proximity: Column, w: RankingWeights = RankingWeights()) -> Column:  # noqa: B008
    fresh = F.greatest(1 - days / 365, F.lit(0.2))
    return relevance * w.relevance + trust * w.trust + fresh * w.recency + density * w.density + proximity * w.proximity + clamp(density) * w.density_again


@dataclass(frozen=True)
class RerankMode:
    """Recency weight and stale penalty of a retrieval mode."""

    recency_weight: float = 0.06
    stale_penalty: bool = False
    deltas: dict = field(default_factory=lambda: {"reusable": 0.08, "synthesized": 0.04, "forming": 0.0, "contested": -0.08, "stale": -0.12})


RERANK_MODES = {"temporal": RerankMode(0.14, True), "canonical": RerankMode(0.02, False), "mixed": RerankMode()}


def rerank_score(
    relevance: Column, trust: Column, days: Column, flags: dict[str, Column], overlap: Column, proximity: Column, state: Column, mode: str = "mixed", faithful: bool = False,
) -> Column:
    """Stage-four score. ``faithful`` treats a relevance or trust of 0 as .5."""
    m = RERANK_MODES[mode]
    fill = (lambda x: F.when(F.coalesce(x, F.lit(0.0)) == 0, 0.5).otherwise(x)) if faithful else (lambda x: F.coalesce(x, F.lit(0.5)))
    bonuses = {"is_core_atom": 0.10, "has_authority": 0.06, "authority_aligned": 0.05, "exact_match": 0.08, "artifact_aligned": 0.05, "contradiction_bound": 0.04, "support_lane": 0.08}
    bonus = sum((when(F.coalesce(flags[k], F.lit(False)), b) for k, b in bonuses.items() if k in flags), F.lit(0.0))
    age = F.coalesce(days, F.lit(9999))
    delta = F.coalesce(F.element_at(F.create_map(*[x for k, v in m.deltas.items() for x in (F.lit(k), F.lit(v))]), state), F.lit(0.0))
    stale = when(age > 365, -0.08) if m.stale_penalty else F.lit(0.0)
    return (
        clamp(fill(relevance)) * 0.54 + clamp(fill(trust)) * 0.22 + F.lit(m.recency_weight) / (1 + age / 365.0) + bonus
        + clamp(F.coalesce(proximity, F.lit(0.0)), 0.0, 0.15) + clamp(F.coalesce(overlap, F.lit(0.0)) * 0.12, 0.0, 0.08) + delta + stale
    )
