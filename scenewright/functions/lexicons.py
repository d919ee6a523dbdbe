"""Word lists and lookup tables. Results depend on every entry."""

# Cues that a scene names a place or a time (matched as substrings).
LOCATION_CUES = "ghar school bazaar bahar andar office kamra kamre gali station park".split()
TEMPORAL_CUES = ["subah", "sham", "raat", "dopahar", "agli baar", "phir", "kal", "aaj", "parso", "thodi der baad"]

# Words that keep their final "a".
SCHWA_EXCEPTIONS = """
kya tha kaha yaha vaha jaha gaya kiya liya diya piya siya likha dekha socha roka khola hota jata aata rehta chahta
uska unka iska inka apna apni pura sara kara para mara tera accha achha bura naya wala wali wale pahala pahle agala agale
""".split()

# Whole-word replacements after romanization.
WORD_FIXES = {"mujhko": "mujhe", "tumko": "tumhe", "kuchh": "kuch", "yahaan": "yahan", "wahaan": "wahan", "kahaan": "kahan"}

# Keywords of social roles, looked for in this order.
ROLE_KEYWORDS = {
    "elder": "pitaji mataji dada nana bade uncle aunty dadaji naani chacha maama bauji ammaji taaya taai nani dadi pardada".split(),
    "authority": "sir madam doctor inspector principal sahib ji adhikari mantri judge collector officer".split(),
}

# Names that are no characters.
NON_CHARACTERS = [
    "dayari", "diary", "kitab", "kitaben", "alamari", "nakshe", "nakshay", "dastavej", "dastavez", "sanket", "log", "chatron",
    "shodhakarta", "shodhakartaon", "nagar", "parishad", "nagar parishad", "vyakti", "bhavan", "pustakalay",
]

# Words that set an emotion, looked for in this order.
EMOTION_TRIGGERS = {
    "angry": "gussa naraaz chillaya maara ladai krodh thappad dant".split(),
    "anxious": "dar ghabra pareshan chinta tension fikar sehma kampa".split(),
    "happy": "khush muskuraya hansa mila success khushi prasan aanand".split(),
    "sad": ["roya", "udaas", "dukh", "aansu", "chala gaya", "bichad", "dard", "takleef"],
    "urgent": "jaldi abhi turant emergency rukna bhago chalo hatao".split(),
}
# Tenths of stress that a scene adds in an emotion, between 0 and 10.
STRESS_TENTHS = {"anxious": 2, "angry": 2, "urgent": 2, "happy": -3}

# Intents, and those that let slang in.
INTENTS = ["REQUEST_URGENCY", "ASSERT_FRUSTRATION", "ASSERT_POSITIVE", "EXPRESS_STRESS", "CASUAL_ASSERTION", "INFORM_NEUTRAL", "QUESTION_FORMAL"]
SLANG_INTENTS = INTENTS[:5]

# Control tokens by intent and by emotion, and the functions that fill a thin pool.
INTENT_CONTROLS = {
    "ASSERT_POSITIVE": ["ASSERT_POSITIVE", "ASSERT_HAPPY", "ASSERT_EXCITED"],
    "ASSERT_FRUSTRATION": ["ASSERT_FRUSTRATION", "ASSERT_ANGER", "ASSERT_NEGATIVE"],
    "EXPRESS_STRESS": ["ASSERT_STRESS", "ASSERT_ANXIETY", "ASSERT_SADNESS"],
    "REQUEST_URGENCY": ["REQUEST_URGENCY", "ASSERT_STRESS"],
}
EMOTION_CONTROLS = {
    "happy": ["ASSERT_HAPPY", "ASSERT_POSITIVE", "ASSERT_EXCITED"],
    "angry": ["ASSERT_FRUSTRATION", "ASSERT_ANGER", "ASSERT_NEGATIVE"],
    "anxious": ["ASSERT_ANXIETY", "ASSERT_STRESS"],
    "urgent": ["REQUEST_URGENCY", "ASSERT_STRESS"],
    "sad": ["ASSERT_SADNESS"],
}
COLOURFUL_FUNCTIONS = "idiom intensifier slang_eval positive_eval negative_eval descriptor modern_slang metaphor".split()
DEFAULT_FILLERS = ["yaar", "bhai", "bro", "boss"]
EDITOR_CONTROLS = {
    "ASSERT_POSITIVE": "ASSERT_POSITIVE", "ASSERT_FRUSTRATION": "ASSERT_FRUSTRATION", "EXPRESS_STRESS": "ASSERT_STRESS",
    "REQUEST_URGENCY": "REQUEST_URGENCY", "CASUAL_ASSERTION": "ASSERT_NEUTRAL",
}

# Canonical control tokens of raw ones.
CANONICAL_CONTROLS = {
    "ASSERT_POSITIVE": "ASSERT_POSITIVE", "POSITIVE_EVAL": "ASSERT_POSITIVE", "ASSERT_HAPPY": "ASSERT_HAPPY",
    "ASSERT_EXCITED": "ASSERT_EXCITED", "ASSERT_SURPRISE": "ASSERT_EXCITED", "ASSERT_NEGATIVE": "ASSERT_NEGATIVE",
    "ASSERT_FRUSTRATION": "ASSERT_FRUSTRATION", "ASSERT_ANGER": "ASSERT_FRUSTRATION", "REQUEST_FRUSTRATION": "ASSERT_FRUSTRATION",
    "ASSERT_STRESS": "ASSERT_STRESS", "EXPRESS_STRESS": "ASSERT_STRESS", "ASSERT_ANXIETY": "ASSERT_ANXIETY",
    "ASSERT_FEAR": "ASSERT_ANXIETY", "ASSERT_SADNESS": "ASSERT_SADNESS", "EXPRESS_SADNESS": "ASSERT_SADNESS",
    "ASSERT_NEUTRAL": "ASSERT_NEUTRAL", "INFO_STATEMENT": "ASSERT_NEUTRAL", "ASSERT_CONFUSION": "ASSERT_CONFUSION",
    "ASSERT_WARNING": "ASSERT_WARNING", "REQUEST_NEUTRAL": "REQUEST_NEUTRAL", "REQUEST_URGENCY": "REQUEST_URGENCY",
}

# English words of the approximate code-mixing index.
ENGLISH_WORDS = """
the a an and or but if of to in on at for with by from as is are was were be been being do does did have has had will would
can could should may might must not no yes this that these those it its he she they we you i me my your his her our their
them him here there where when why how what who which all any some more most much many few library project material monument
record records history historical diary note notes chest lock locked key door city council public private book books page
pages research researcher student students paper old ancient dust dusty leather cover clue clues map maps merchant trader
poor family families help helped truth quest search document documents proof statue memory memories time future past present
story stories people person good bad great nice cool awesome unique special secret hidden lost found discover discovered
evidence archive decided honor honored society building room shelf cupboard morning evening night day light shadow silence
quiet
""".split()

# Grammatical words that are no slang.
GRAMMAR_WORDS = """
hai hain ho hota hoti gaya gayi gaye ka ki ke ko se mein me par aur ya ye yeh wo woh na nahi nahin kar karo kya hi to tha thi
the raha rahi rahe ab mera meri tera teri apna is us kal aaj ek bahut bhi
""".split()

# Words that don't show that an event is told.
EVENT_STOP_WORDS = "the a an is was in of and to ka ki ke ko se par hai tha thi ne aur woh yeh ek mein kar raha rahi rahe".split()
