"""Token vocabularies of the text rules. The variants differ by purpose and must not be unified."""

#: Legal suffixes that a name key drops at its end.
LEGAL_SUFFIXES = "limited ltd inc corp corporation company co private pvt plc".split()
#: Of these, what is dropped before initials are taken.
INITIALISM_SUFFIXES = [x for x in LEGAL_SUFFIXES if x not in ("company", "co")]
#: Legal suffixes of the coverage tracker.
TRACKER_SUFFIXES = [*LEGAL_SUFFIXES, "sa", "nv", "ag"]
#: Words that a lookup key drops anywhere.
LOOKUP_STOP_WORDS = "limited ltd inc corp corporation company co private pvt plc ag sa group holdings holding technologies technology india ind".split()
TRACKER_STOP_WORDS = ["the", "a", "an", "of", "and", "&"]
#: Words that are read as another one.
TOKEN_EQUIVALENTS = {"tech": "technology", "technologies": "technology", "inds": "industries", "hathaway": "hathway", "prod": "products"}
ACRONYM_EXPANSIONS = {"amc": "asset management company"}
TRACKER_ABBREVIATIONS = {
    "inds": "industries", "ins": "insurance", "internatl": "international", "intl": "international", "fin": "finance",
    "invest": "investment", "engg": "engineering", "ent": "enterprises", "mfg": "manufacturing", "dev": "development",
    "mgmt": "management", "infra": "infrastructure", "hind": "hindustan",
}
#: A name extended by these only stays the same name.
SOFT_WORDS = "india indian group global international holding holdings".split()
INITIALISM_IGNORED = ["and", "of", "the"]
COMPANY_HINTS = (
    "bank bancorp bancshares beverages bio biosciences capital chemicals company communications corp corporation energy engineering financial foods group "
    "holding holdings inc industries insurance international labs limited ltd motors pharma pharmaceuticals plc private pvt retail sa systems technologies technology"
).split()
SENTENCE_STARTS = "we we've our this that these those broader sectoral check have introducing given are".split()
SECTOR_HEADINGS = [
    "banking and financial services", "capital goods and engineering", "cement and construction materials", "consumer appliances and retail", "food and beverage",
    "global", "hospitality and hotels", "new years edition", "pharmaceuticals and chemicals", "real estate", "textiles",
]
SECTOR_WORDS = (
    "aerospace airlines appliances auto automobile automobiles banking beverage capital cement chemicals communication construction consumer defence engineering "
    "estate financial food goods healthcare hospitality hotels infrastructure insurance materials metals mining oil pharmaceuticals power real retail services "
    "telecom textiles transport utilities"
).split()
SPEAKER_TITLES = ["management", "ceo", "cfo", "md", "chairman", "analyst"]
HARD_BREAKS = ["tidbits", "the bottomline", "bottomline"]
NON_STORY_HEADINGS = [*HARD_BREAKS, "ready for more"]
PROMO_PREFIXES = ["we re now on reddit", "check out", "have you checked out", "subscribe to"]
EXCHANGES = ["NSE", "BSE"]
