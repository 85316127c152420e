"""Word lists, weights and names that the operators must agree on. All of them can be replaced by parameters."""

#: Query parameters that only track visitors (compared in lower case).
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "mc_cid", "mc_eid", "igshid")

#: Words that never begin or continue a proper-noun run in a title.
ENTITY_STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by", "from", "up", "about", "into", "over", "after", "its", "it", "this", "that", "new", "says", "said", "will", "would", "could", "should", "as", "is", "are", "was", "were", "has", "have", "had", "been", "news", "report", "update", "breaking", "exclusive", "first", "watch", "live", "amid", "under")

#: Words that say nothing about which story a title belongs to.
CLUSTER_STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by", "from", "up", "about", "into", "over", "after", "its", "it", "this", "that", "says", "said", "will", "would", "could", "should", "as", "is", "are", "was", "were", "has", "have", "had", "been", "news", "report", "update", "new", "amid", "first", "watch", "live", "amidst", "following", "during")

#: Known names by type, with the confidence of a dictionary match.
ORGANIZATIONS = ("united nations", "un", "who", "nato", "eu", "european union", "imf", "world bank", "bbc", "reuters", "associated press", "cnn", "nasa", "fbi", "cia")
BRANDS = ("apple", "google", "microsoft", "amazon", "tesla", "meta", "nvidia", "openai", "samsung", "sony", "spacex")
COUNTRIES = ("united states", "usa", "uk", "britain", "nigeria", "china", "ukraine", "russia", "germany", "france", "japan", "india")
CITIES = ("london", "lagos", "abuja", "tokyo", "paris", "washington", "new york", "beijing", "kyiv", "berlin")

CATEGORY_WEIGHTS = {"world": 85.0, "politics": 85.0, "business": 80.0, "technology": 80.0, "science": 75.0, "health": 75.0, "diplomacy": 85.0, "robotics": 80.0, "entertainment": 60.0, "sports": 60.0, "general": 50.0}
TRUST_WEIGHTS = {"low": 0.5, "medium": 1.0, "high": 1.5, "verified": 2.0}
TRENDING_WEIGHTS = {"velocity": 0.30, "freshness": 0.25, "corroboration": 0.25, "relevance": 0.20}

#: Phrases that credit a source.
ATTRIBUTION_MARKERS = ("according to", "said", "says", "reported", "reports", "reporting", "told", "announced", "confirmed", "stated", "via ", "from ")
CREDIT_MARKERS = ("according to", "said", "reported", "reports", "via")
DESK_TERMS = ("headlines", "read", "story", "coverage", "updates", "developments", "trending", "emerging", "rising", "peak", "cooling", "stale")
GUARD_STOP_WORDS = ("the", "a", "an", "this", "that", "these", "those", "and", "or", "but", "if", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

QUALITY_WEIGHTS = {"evidence_coverage": 0.25, "factual_support": 0.25, "attribution": 0.15, "completeness": 0.10, "clarity": 0.10, "headline_quality": 0.10, "risk_level": 0.05}
HARD_PENALTIES = {"CONFLICTING_SOURCES": 8, "UNSUPPORTED_CLAIM": 10}
CLICKBAIT_TERMS = ("you won't believe", "shocking", "mind-blowing", "insane", "unbelievable", "must-see", "gone wild", "explosive", "secret")
SUPERLATIVE_TERMS = ("best ever", "greatest ever", "worst ever", "historic", "unprecedented", "record-breaking")
REQUIRED_SECTIONS = {"article": ("headline", "dek", "body"), "summary": ("summary", "key_facts"), "social": ("caption", "call_to_action"), "headlines": ("headline", "alternate_headlines")}
RISK_WEIGHTS = {"UNSUPPORTED_CLAIM": 30, "UNSUPPORTED_ENTITY": 25, "UNSUPPORTED_NUMBER": 25, "UNSUPPORTED_DATE": 25, "UNSUPPORTED_QUOTE": 30, "UNSUPPORTED_URL": 25, "MISSING_ATTRIBUTION": 15, "LOW_EVIDENCE": 10, "CONFLICTING_SOURCES": 20}
SERIOUS_FLAGS = ("UNSUPPORTED_CLAIM", "UNSUPPORTED_ENTITY", "UNSUPPORTED_NUMBER", "UNSUPPORTED_DATE", "UNSUPPORTED_QUOTE", "CONFLICTING_SOURCES")

DRAFT_TYPES = {"HEADLINES": "NEWS_UPDATE", "SUMMARY": "EXPLAINER", "ARTICLE": "ARTICLE", "SOCIAL": "SOCIAL_POST", "PACKAGE": "ARTICLE"}
PLATFORMS = {"SOCIAL_POST": "facebook", "SHORT_CAPTION": "instagram", "BREAKING": "web-breaking"}

#: Payload schemas: field and whether it is a list.
PAYLOAD_SCHEMAS = {
    "headline_result": {"headline": False, "alternate_headlines": True, "reasoning_summary": False, "risk_flags": True},
    "summary_result": {"summary": False, "key_facts": True, "risk_flags": True},
    "article_result": {"headline": False, "dek": False, "body": False, "key_facts": True, "uncertainties": True, "risk_flags": True},
    "social_result": {"caption": False, "headline": False, "call_to_action": False, "hashtags": True, "risk_flags": True},
}
