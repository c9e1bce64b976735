"""Word lists and patterns of the note language. Results depend on each of them."""

UP_WORDS = """up rose rise rises rising risen grew grow grows growing growth increased increase increases increasing gained gain
gains jumped jump surged surge climbed climb soared higher improved uplift added rebound rebounded rebounding advanced advance
spiked spike leapt leaped accelerated expanded recovered rallied bounced rocketed skyrocketed ballooned swelled doubled tripled
outperformed firmed strengthened picked""".split()
DOWN_WORDS = """down fell fall falls falling fallen declined decline declines declining decreased decrease decreasing dropped
drop drops dropping lost loss slipped slip slid plunged plunge tumbled lower contracted contraction shrank dip dipped slumped
slump sank sunk plummeted plummet retreated eased sagged shed collapsed crashed halved weakened softened shrunk shrinking slowed
cooled deteriorated underperformed""".split()
LEVEL_WORDS = "to at from reaching reached totaling totalling was were is".split()
PERIOD_TOKENS = "wow yoy lw ly tw week-on-week year-on-year week-over-week year-over-year".split()
COMPARE_WORDS = "on vs vs. versus from against compared over".split()
GIVE_WORDS = "give gives gave given giving".split()
MAKE_WORDS = "make makes made making add adds sum sums summed pick picks picked end ends ended".split()
HEDGES = {
    "approx": ["about", "around", "roughly", "approximately", "nearly", "almost", "circa", "c.", "~", "some", "close to", "just under", "just over", "just below", "just above", "approx.", "approx"],
    "over": ["more than", "over", "above", "exceeding", "at least", "upwards of", "north of", "in excess of"],
    "under": ["less than", "under", "below", "at most", "fewer than", "short of", "no more than"],
}
CHANGE_NOUNS = "decline drop gain swing increase decrease change fall rise loss uplift movement difference shift shortfall improvement growth contraction".split()
FAMILY_STOP = "of the and set a in with for to on at by or".split()
METRICS = {"rank": r"\brank", "share": r"\bshare", "units": r"\bunits?\b", "orders": r"\borders?\b|\binvoices?\b", "revenue": r"\brevenue\b|\bsales\b"}
PERIODS = {
    "WoW": r"\bwow\b|week[- ]over[- ]week|week[- ]on[- ]week|vs\.? ?lw\b|versus lw\b|vs\.? last week", "YoY": r"\byoy\b|year[- ]over[- ]year|year[- ]on[- ]year|vs\.? ?ly\b|versus ly\b|vs\.? last year",
    "LW": r"\blw\b|last week|prior week|previous week", "LY": r"\bly\b|last year|prior year|same week last year", "TW": r"\btw\b|this week",
}
AGGREGATE_WORDS = """total totals totalled totaled totalling totaling overall top all across combined together average mean median
rest other others remaining portfolio business aggregate collectively jointly between\\s+them lines colourways family sum summed
listed shown whole entire table every""".split()
COUNT_NOUNS = "units?|orders?|invoices?|customers?|items?|transactions?|pieces?|baskets?"
COUNTING_NOUNS = "countries|products|markets|regions|entities|lines|skus|stores|weeks|days|months|categories|rows|of them|colourways|items listed"
COUNTING_BEFORE = "top bottom first last next past".split()
ALIASES = {
    "uk": "United Kingdom", "u.k.": "United Kingdom", "britain": "United Kingdom", "great britain": "United Kingdom", "british": "United Kingdom", "ireland": "EIRE", "irish": "EIRE",
    "the netherlands": "Netherlands", "holland": "Netherlands", "dutch": "Netherlands", "south africa": "RSA", "united states": "USA", "american": "USA", "german": "Germany", "french": "France",
    "spanish": "Spain", "belgian": "Belgium", "swiss": "Switzerland", "portuguese": "Portugal", "italian": "Italy", "australian": "Australia", "japanese": "Japan", "swedish": "Sweden",
    "norwegian": "Norway", "danish": "Denmark", "finnish": "Finland", "austrian": "Austria", "polish": "Poland", "greek": "Greece", "cypriot": "Cyprus", "icelandic": "Iceland", "israeli": "Israel",
    "lebanese": "Lebanon", "maltese": "Malta", "brazilian": "Brazil", "canadian": "Canada", "czech": "Czech Republic", "lithuanian": "Lithuania", "bahraini": "Bahrain", "saudi": "Saudi Arabia",
}

NUMBER = (
    r"(?U)(?<![\w.,%)])([-+−–])?([£$€]|(?:GBP|USD|EUR)\s?)?([-+−–])?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(st|nd|rd|th)?"
    r"(\s?(?:bn|mn|[kKmMB]|thousand|million|billion)(?![A-Za-z]))?"
    r"(\s?(?:%|percentage\s?points?|percent|per\s?cent|pct|pc\b|pp\b|pts\b|points\b|p\.p\.|x(?![A-Za-z])|times\b|-?fold\b|GBP\b|USD\b|EUR\b))?"
)
DATE = r"(?i)\b\d{4}-W\d{1,2}\b|\b\d{4}-\d{2}-\d{2}\b|\b(?:iso\s+)?(?:week|wk)\s?#?\d{1,2}\b|\bW\d{1,2}\b"
SENTENCE_END = r"(?<!\bvs\.)(?<!\bc\.)(?<=[.!?;])\s+(?=[A-Z£$€(])"
TRAILING_DIRECTION = r"(?i)^\s*(TW|LW|LY)?\s*,?\s*\(?(down|up|falling|rising|fell|rose|declin\w*|increas\w*|drop\w*|ris\w*|grew|growing)\s+(from|on|versus|vs)"

# Words next to a claim's value: of a level, passed over before a noun of change, and last year's.
TO_LEVEL = ["from", "to", "reaching", "reached"]
PASSED_OVER = ["a", "an", "of", "by", "some", "the", "at", "absolute"]
LAST_YEAR = ["yoy", "ly", "year"]
PERIOD_LABELS = {"tw": "TW", "lw": "LW", "ly": "LY", "wow": "WoW", "yoy": "YoY"}
# What a claim's name loses before it is compared, and names of the whole table.
NAME_CLEANING = [(r"\(.*?\)", " "), (r"^\s*(?i:the)\s+", ""), (r"['’]s\s*$", ""), (r"(?i)\s+(lines?|products?|item|sales|revenue)\s*$", ""), (r"\s+", " ")]
WHOLE_TABLE = r"\b(all|every)\b.*\b(products|countries|markets|entities|rows|lines|items)\b"
