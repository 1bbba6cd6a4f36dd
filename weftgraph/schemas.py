"""Closed value sets of the graph model."""

from __future__ import annotations

# The model's closed enums and rank tables.
ENTITY_TYPES = (
    "Person", "Organization", "Location", "Product", "Technology", "Concept", "Event", "Document", "Category", "Brand",
    "Feature", "Specification", "GENE", "PROTEIN", "DISEASE", "DRUG", "PATHWAY", "COMPOUND",
)
RELATIONSHIP_TYPES = (
    "RELATED_TO", "PART_OF", "CONTAINS", "LOCATED_IN", "WORKS_FOR", "MANUFACTURES", "DEVELOPS", "HAS_FEATURE",
    "COMPATIBLE_WITH", "DEPENDS_ON", "INFLUENCES", "AUTHORED_BY", "PUBLISHED_BY", "CATEGORIZED_AS",
)
TRUST_PRIORITY = {"curated": 100, "reviewed": 75, "extracted": 50, "user": 25}
STATUS_RANK = {"rejected": 0, "flagged": 1, "unverified": 2}
# Shares of a job's progress.
STAGE_WEIGHTS = {"fetch": 0.04, "chunk": 0.04, "entities": 0.38, "relationships": 0.34, "verify": 0.16, "finalize": 0.04}
# Signs of a negated description.
NEGATIONS = (
    "no ", "not ", "doesn't ", "does not ", "isn't ", "is not ", "hasn't ", "has not ", "won't ", "cannot ", "can't ",
    "lack ", "absent ", "without ", "fails to ", "unable to ",
)
# Words that a search leaves out.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "shall", "should", "may", "might", "must", "can", "could", "and", "but", "or", "nor", "not",
    "so", "yet", "both", "either", "neither", "each", "every", "all", "any", "few", "more", "most", "other", "some",
    "such", "no", "only", "own", "same", "than", "too", "very", "just", "because", "as", "until", "while", "of", "at",
    "by", "for", "with", "about", "against", "between", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "what", "which", "who", "whom", "this", "that", "these", "those", "its",
    "it", "he", "she", "they", "them",
)
# Statuses of jobs that have ended.
TERMINAL_JOBS = ("completed", "failed", "cancelled")
