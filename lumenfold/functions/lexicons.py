"""Word sets. They are parameters everywhere: these are the defaults."""

from __future__ import annotations

Lexicon = dict[str, tuple[str, ...]]


def lexicon(**categories: str) -> Lexicon:
    """Categories in the order that decides ties, each with its words."""
    return {name: tuple(words.split()) for name, words in categories.items()}


# The default word sets must be these for the results to agree.
SIGNALS = lexicon(
    gratitude="grateful gratitude thankful appreciate appreciated blessing blessed lucky",
    strain="stress stressed overwhelmed anxious anxiety panic afraid worried worry pressure exhausted tired hard heavy sad angry frustrated",
    connection="friend friends family mom dad partner together talked called met shared love loved held",
    growth="learned realized noticed understood practice change changed growing growth progress try trying",
    body="body breath breathing sleep slept tired energy walk walked run ran exercise hungry rest",
    presence="present quiet still pause paused breathe breath noticed listen listened aware awareness mindful",
    agency="choose chose choice decide decided boundary boundaries ask asked make made plan planned",
    uncertainty="maybe uncertain unsure confused question wonder wondering doubt doubtful unknown stuck",
    joy="joy happy delight delighted laughed laughing fun beautiful peace peaceful good excited",
    restoration="rest rested restore restored repair repaired heal healing soft gentle slow ease safe",
)
NEEDS = lexicon(
    rest="rest sleep slow quiet ease recover tired",
    connection="together friend family call called love",
    clarity="clear clarity understand realized decide",
    safety="safe secure home steady stable trust",
    meaning="meaning purpose values important matter",
    freedom="free freedom choice space permission",
)
TENSES = lexicon(
    past="was were had remember remembered used",
    present="am is are now today currently feel",
    future="will going tomorrow soon hope plan want",
)
RATES = lexicon(
    first_person_singular="i me my mine myself",
    first_person_plural="we us our ours ourselves",
    other_person="you your yours he him his she her hers they them their theirs",
    insight="realize realise realized realised understand understood know knew think thought consider considered wonder wondered aware recognize recognise recognized sense figure figured reflect reflected notice noticed",
    causation="because cause caused causes effect hence therefore thus since reason why consequently result results due",
    tentative="maybe perhaps possibly probably might guess suppose seems seem seemed unsure somewhat fairly apparently",
    certainty="always never definitely certainly sure clearly obviously absolutely completely totally undoubtedly must",
    negation="no not never none nobody nothing neither nor cannot cant wont dont didnt isnt wasnt arent werent",
)
FUTURE_MARKERS = tuple("will shall gonna going".split())
EMOTIONS = tuple(
    "admiration amusement anger annoyance approval caring confusion curiosity desire disappointment disapproval disgust "
    "embarrassment excitement fear gratitude grief joy love nervousness optimism pride realization relief remorse "
    "sadness surprise neutral".split()
)
STOPWORDS = frozenset(
    "the and was that for with this but not are have had you she they them then there some would really today don't "
    "didn't i'm it's its get got going went one did can could will much more also think know feel felt feeling because "
    "after before day time now still even things thing lot bit how into just like about all out when what been were over "
    "back again very good new see way make made want wanted little last from which while where who your our his her him "
    "has does doesn't won't can't myself being than too off down most other something someone maybe though around here "
    "should need needs trying kind sort actually right first".split()
)

#: The rates' names among the signals of a chunk.
RATE_KEYS = {"first_person_singular": "self_focus", "first_person_plural": "we_focus", "other_person": "other_focus"}
