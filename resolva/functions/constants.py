"""Fixed values. They must be what they are for results to agree with published ones."""

LEGAL_TERMS = [
    "llc", "inc", "incorporated", "corp", "corporation", "ltd", "limited",
    "pvt", "private", "pllc", "pc", "co", "company", "lp", "llp", "gmbh",
    "sarl", "sasu", "sas", "eurl", "sa", "snc", "scs", "sci", "gie",
    "pvt ltd", "private limited", "limited liability", "limited liability company",
]

LEGAL_PHRASES = ["private limited", "pvt ltd", "limited liability company", "limited liability"]

ABBREVIATIONS = {
    "corp": "corporation", "inc": "incorporated", "ltd": "limited", "pvt": "private", "co": "company", "mfg": "manufacturing",
    "intl": "international", "assoc": "associates", "tech": "technology", "mgmt": "management", "svcs": "services", "svc": "service",
    "grp": "group", "ent": "enterprise", "ind": "industries", "hldg": "holdings",
}

STREETS = {
    "rd": "road", "st": "street", "dr": "drive", "ave": "avenue", "ln": "lane", "blvd": "boulevard", "bd": "boulevard", "ct": "court",
    "cir": "circle", "hwy": "highway", "pkwy": "parkway", "ste": "suite", "fl": "floor", "apt": "apartment", "bldg": "building",
    "pl": "place", "sq": "square", "ter": "terrace", "r": "rue", "av": "avenue", "imp": "impasse", "all": "allee", "chem": "chemin",
}

ADDRESS_STOP_WORDS = [
    "st", "street", "rd", "road", "dr", "drive", "ave", "avenue", "ln", "lane",
    "blvd", "boulevard", "ct", "court", "cir", "circle", "hwy", "highway",
    "fl", "floor", "ste", "suite", "apt", "apartment", "unit", "po", "box",
    "near", "opp", "opposite", "behind", "beside", "block", "sector", "plot",
    "no", "h", "city", "state", "west", "east", "north", "south",
    "rue", "impasse", "allee", "place", "chemin", "batiment",
]

# Latin for the letters of the Brahmic blocks, by place in the block (code point modulo 0x80)
BRAHMIC = {
    0x02: "m", 0x03: "h",
    0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u",
    0x0B: "ri", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n",
    0x1A: "ch", 0x1B: "ch", 0x1C: "j", 0x1D: "jh", 0x1E: "n",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n",
    0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m",
    0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x35: "v",
    0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u",
    0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au",
}

GRAMS = {
    "mg": 0.001, "g": 1.0, "gm": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "kgs": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0,
    "oz": 28.3495, "ounce": 28.3495, "ounces": 28.3495, "lb": 453.592, "lbs": 453.592, "pound": 453.592, "pounds": 453.592,
}

MILLILITRES = {
    "ml": 1.0, "milliliter": 1.0, "millilitre": 1.0, "millilitres": 1.0, "milliliters": 1.0, "l": 1000.0, "ltr": 1000.0, "litre": 1000.0,
    "liter": 1000.0, "litres": 1000.0, "liters": 1000.0, "fl oz": 29.5735, "fluid ounce": 29.5735, "gallon": 3785.41,
}

OTHER_UNITS = ["count", "pcs", "piece", "pieces", "units", "tablets", "capsules", "sheets", "sachets"]

KEYWORDS = [
    "combo", "pack", "set", "organic", "refill", "premium", "pro", "plus", "mini", "max", "ultra", "wireless", "rechargeable",
    "genuine", "original", "warranty", "waterproof", "portable", "natural",
]

CHANNELS = [
    "exact_name", "exact_addr", "exact_both", "rare_token", "bm25_name", "bm25_addr", "numeric_loc", "cross_script",
    "missing_field", "sibling", "reverse",
]
