"""Word lists and class names that results depend on."""

# The five author classes, in the order in which answers are searched for them.
LABELS = ["Anthropic", "Google", "Human", "Meta", "OpenAI"]

# The class that stands in for a missing answer.
DEFAULT_LABEL = "Human"

# Default stop words of the word vectorizers.
STOP_WORDS = """
a an the and or but in on at to for of with by from is are was were be been being have has had do does did
will would could should may might shall can this that these those it its i me my we our you your he she they them
their not no nor so if as than then also just about which what who whom when where how all each every both more most
other some such only own same too very up out into over after before between through during above below any there here
""".split()

# Words counted by the buzzword share.
BUZZWORDS = "furthermore moreover delve tapestry testament pivotal underscore multifaceted crucial consequently".split()

# Words counted by the function-word share and entropy.
FUNCTION_WORDS = "the of to and a in that is it for on with as at this by from or an be are was were".split()

# Elements and element classes that an encyclopaedia page is stripped of.
DROPPED_ELEMENTS = ["math", "sup", "table", "style"]
DROPPED_CLASSES = ["infobox", "metadata", "reflist", "navbox", "reference", "toc", "mwe-math-element"]

# Letters by which a passage between slashes is taken for a phonetic transcription.
PHONETIC = "ˈˌːɪəʊɛæɔɒʌ"

# Bounds of a passage's length in words.
MIN_WORDS, MAX_WORDS = 80, 120
