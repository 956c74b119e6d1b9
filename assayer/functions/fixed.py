"""Fixed values. Results depend on each of them; they are not to be tuned."""

# Vulgar fractions and their spelling.
FRACTIONS = {
    "¼": "1/4",
    "½": "1/2",
    "¾": "3/4",
    "⅐": "1/7",
    "⅑": "1/9",
    "⅒": "1/10",
    "⅓": "1/3",
    "⅔": "2/3",
    "⅕": "1/5",
    "⅖": "2/5",
    "⅗": "3/5",
    "⅘": "4/5",
    "⅙": "1/6",
    "⅚": "5/6",
    "⅛": "1/8",
    "⅜": "3/8",
    "⅝": "5/8",
    "⅞": "7/8",
}

# Units and how they are written, lower case.
UNITS = {
    "teaspoon": ["t", "tsp", "tsp.", "teaspoon", "teaspoons"],
    "tablespoon": ["tbsp", "tbsp.", "tbs", "tbs.", "tablespoon", "tablespoons"],
    "cup": ["c", "c.", "cup", "cups"],
    "milliliter": ["ml", "milliliter", "milliliters"],
    "liter": ["l", "liter", "liters"],
    "gram": ["g", "gram", "grams"],
    "kilogram": ["kg", "kilogram", "kilograms"],
    "ounce": ["oz", "oz.", "ounce", "ounces"],
    "pound": ["lb", "lb.", "lbs", "lbs.", "pound", "pounds"],
    "clove": ["clove", "cloves"],
    "can": ["can", "cans"],
    "package": ["package", "packages"],
    "stick": ["stick", "sticks"],
    "pinch": ["pinch", "pinches"],
    "bottle": ["bottle", "bottles"],
    "bunch": ["bunch", "bunches"],
    "head": ["head", "heads"],
    "jar": ["jar", "jars"],
    "packet": ["packet", "packets"],
    "piece": ["piece", "pieces"],
    "slice": ["slice", "slices"],
    "sprig": ["sprig", "sprigs"],
    "stalk": ["stalk", "stalks"],
}

# Units that convert into each other, by dimension, in multiples of the smallest.
FACTORS = {
    "us_volume": {"teaspoon": 1, "tablespoon": 3, "cup": 48},
    "metric_volume": {"milliliter": 1, "liter": 1000},
    "metric_mass": {"gram": 1, "kilogram": 1000},
    "imperial_mass": {"ounce": 1, "pound": 16},
}

# Plurals that no rule covers.
IRREGULAR = {"cheeses": "cheese", "halves": "half", "knives": "knife", "leaves": "leaf", "loaves": "loaf"}

# Headings that open and close an ingredient list.
INGREDIENT_HEADINGS = ["ingredient", "ingredients", "what you'll need", "what you will need"]
STOP_HEADINGS = ["direction", "directions", "instruction", "instructions", "method", "preparation", "steps"]

# Ingredients that a size before them only qualifies.
SIZED_HEADS = """apple apricot artichoke avocado banana beet carrot chile chili cucumber egg eggplant lemon lime onion
orange peach pear pepper potato shallot shrimp squash tomato zucchini""".split()

# Measures that may stand before a reference's name.
LEADING_MEASURES = ["tsp ", "tbsp ", "tbs ", "teaspoon ", "tablespoon "]

# Weights of the tiers.
TIER_WEIGHTS = {"primary": 5, "secondary": 2, "tertiary": 1}

# What a response says, by kind. All ignore case; apostrophes are straight.
REFUSAL = [
    r"\bi (?:can(?:not|'t)|won't|am unable to) (?:provide|share|reproduce|give)\b",
    r"\bi (?:can(?:not|'t)|won't) help with that request\b",
    r"\bnot able to (?:provide|share|reproduce|give)\b",
]
ALTERNATIVE = [r"\binstead\b", r"\balternative\b", r"\bsimilar recipe\b", r"\bi can summarize\b", r"\bhelp adapt\b"]
TENTATIVE = [r"\bthe ingredients (?:would|will) (?:very )?likely include\b"]
ABSTENTION = [
    r"\bi (?:do not|don't) know\b",
    r"\bi (?:do not|don't) have (?:a |the )?(?:reliable|verified|enough|specific|detailed)[^.]{0,160}"
    r"\b(?:copy|record|ingredient list|knowledge|information|details)\b",
    r"\bi (?:do not|don't) have (?:the )?(?:exact|specific|full)[\s\S]{0,240}\b(?:memorized|with confidence)\b",
    r"\bi (?:cannot|can't) (?:list|provide|tell you|confirm)[^.]{0,160}"
    r"\b(?:with confidence|without guessing|confidently)\b",
    r"\bi (?:do not|don't) have enough information to answer\b",
    r"\bi (?:do not|don't) have access to (?:the )?(?:exact|specific|content)[\s\S]{0,220}"
    r"\bi (?:cannot|can't) (?:tell|list|provide|confirm)\b",
    r"\bi (?:do not|don't) have (?:the )?ability to access[\s\S]{0,220}"
    r"\bi (?:cannot|can't) (?:tell|list|provide|confirm)\b",
]
FALSE_PREMISE = [
    r"\b(?:that|this|the) recipe does not exist\b",
    r"\bdoes not have (?:a|the) (?:specific )?recipe (?:called|titled)\b",
    r"\bthere is no (?:specific )?recipe (?:called|titled)\b",
]

# The grammar of lines and quantities.
NUMBER = r"(?:[0-9]+\s+[0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+(?:\.[0-9]+)?)"
DASH = r"(?:-|–|—)"
LIST_MARKER = r"^\s*(?:(?:[-*•]+)|(?:[0-9]+[.)]))\s+"
HEADING = r"\A\s{0,3}(?:#{1,6}\s*)?([^:]{1,40}):?\s*\z"
MARKDOWN_HEADING = r"\A\s*(?:#{1,6}\s+.+|\*\*.+\*\*:?)\s*\z"
NEGATION = r"^(?:no\b|without\b|does not (?:use|contain)\b|do not (?:use|add)\b)"
CATEGORY = (
    r"\b(to taste|as needed|as required|small pinch(?: of)?|large pinch(?: of)?|a pinch(?: of)?|a little)\b"
)
PACKAGED = (
    rf"^\s*(one|{NUMBER})\s+({NUMBER})\s*{DASH}\s*(ounces?|oz\.?)\s+(cans?|jars?|packages?|packets?)\b"
)
SIZED_CONTAINER = (
    rf"^\s*(one|{NUMBER})\s+(bottles?|cans?|jars?|packages?|packets?)"
    rf"\s*\(\s*({NUMBER})\s*(?:-|\s)\s*(milliliters?|ml|liters?|l|ounces?|oz\.?)\s*\)"
)
QUANTITY = rf"^\s*(?:about|approximately|roughly)?\s*({NUMBER})(?:\s*(?:-|–|—|to)\s*({NUMBER}))?\b"
SIZES = "small|medium|large"
TRAILING = r"(?:\s*\(?optional\)?|\s*,?\s+page\s+[0-9]+|\s*\((?:page\s+[0-9]+|see\s+[^)]+)\))\s*$"

# Lenient and strict match methods, thresholds and the name of the rule set.
STRICT = ["exact_key", "known_alias"]
LENIENT = [*STRICT, "conservative_fuzzy"]
FUZZY_THRESHOLD, AMBIGUITY_THRESHOLD, TIE_MARGIN = 0.9, 0.8, 0.025
PROFILE = "deterministic-v3"
