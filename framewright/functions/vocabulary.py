"""Words of the caption rules."""

from __future__ import annotations


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# ---- Fixed values: the rules' results depend on exactly these words and phrases. ----
NOTHING = frozenset(("n/a", "na", "n.a", "n.a.", "n / a", "not applicable", "no action", "no clear action", "nothing", "nothing visible", "no interaction", "no contact", "idle hands", "none", "no manipulation"))
VAGUE = _words("item items thing things object objects stuff piece pieces something hand hands finger fingers action")
SOFT_VAGUE = _words("food container package appliance contents surface material ingredient vegetable fruit tool utensil part")
BAD_PRONOUNS = _words("them its these those this their")
WEAK_ADJECTIVES = _words("small large big little tiny white black red green blue yellow brown orange pink dark light round flat long thin cylindrical spherical rectangular wrapped sliced chopped diced peeled cooked dried frozen fried baked roasted metallic plastic wooden silver gold metal next other same certain")
ARTICLES = _words("the a an")
DETERMINERS = ARTICLES | _words("another some each")
REJECTED_VERBS = _words("touch point search feel look see observe notice examine inspect operate guide manipulate handle direct gesture wave signal indicate assist help repeat interact use work manage contact approach rest remain stay maintain keep display show view offer mow trim vacuum sweep drive steer walk clap follow play")
STABILIZING = _words("hold steady stabilize support grip")
TRANSPORT = _words("carry bring transport")
PARTICLES = _words("up down on off out in away over back apart")
FOODS = _words("bread butter cream flour honey milk oil pepper salt sugar water")
NOT_VERBS = _words("cup plate bowl lid jar mug tray bin rack pot pan cap tin box bag forth person")
PLACE_PREPOSITIONS = _words("in into on onto to from within across toward towards along near beside behind above below under over against between")
AFTER_IT_PREPOSITIONS = _words("in into on onto to from toward towards under over through across along near beside behind above below against between")
DIRECTIONS = _words("left right forward backward backwards")
MANNERS = _words("together gently carefully slowly quickly firmly slightly")
HEAD_PREPOSITIONS = _words("to into onto on in from off out inside outside over under at near beside behind above below against between")
JOINT_WORDS = _words("together jointly")
CROSS_HAND = (" while ", " whilst ", " as the ", "the right hand", "the left hand", "right hand", "left hand", "other hand", "both hands", "together", "simultaneously")
BIMANUAL_REJECT = ("while holding", "while gripping", "while supporting", "while steady", "cooperat", "coordinat", "collaborat", "work together", "assist", "help")
HAND_REFERENCES = ("left hand", "right hand", "both hands", "each hand", "one hand", "other hand", "two hands")
OVERLAY = _words("overlay overlays marker markers dot dots trail trails circle circles indicator indicators trajectory trajectories")
GENERIC_VERBS = _words("prepare organize arrange rearrange sort clean tidy share")
GENERIC_NOUNS = _words("task activity process")
ALWAYS_VAGUE = _words("something stuff")
CHECKED_VAGUE = _words("object objects item items thing things piece pieces material materials contents")
RELATIONAL = _words("other same certain next")
TEXT_GATE = (("tool", "continuous_tool"), ("vehicle", "continuous_tool"), ("support", "support_only"), ("hold", "support_only"), ("steady", "support_only"), ("generic", "generic_summary"), ("summary", "generic_summary"), ("vague", "vague_object"), ("unidentif", "vague_object"), ("cross", "cross_hand"), ("other hand", "cross_hand"), ("predict", "prediction"), ("weak", "weak_verb"))
PERSON_WORDS = ("another person", "other person", "second person", "rule 8", "rule8")
SELF_WORDS = ("self-contact", "self contact", "own body", "own person", "own clothing", "currently being worn", "currently worn", "worn item", "worn items", "worn clothing", "worn accessory", "worn accessories", "rule 9", "rule9")
TOOL_WORDS = ("mow", "trim", "vacuum", "sweep", "drill", "grind", "weld", "solder", "polish", "stir", "driv", "steer")
TOOL_ING = ("sawing", "sanding", "ironing")
GLOBAL_TAGS = ("other_person", "self_contact", "walking", "dark", "continuous_tool")
FREE_CODES = (
    (("continuous", "repetitive"), "continuous_generic"),
    (("stabiliz", "only hold", "only grip"), "stabilizing"),
    (("not observed", "not visible", "wrong", "mismatch", "inconsistent", "unsupported", "over-specif"), "inconsistent"),
    (("unclear object", "ambiguous", "cannot identify", "unidentifiable"), "unclear_object"),
    (("no contact", "hover", "idle", "no interaction", "no purposeful"), "no_contact"),
    (("untracked", "wrong region", "misaligned"), "untracked"),
    (("bimanual", "not shared"), "bimanual"),
)
# ---- End of the fixed values. ----

#: Base verbs that the built-in lemmatiser knows; a dictionary can be passed instead.
VERBS = _words(
    "adjust align apply arrange assemble attach bake beat bend bite blend blow boil break bring brush build button carry catch change check chop clean clear clip close coil collect "
    "comb connect cook cover crack crush cut detach dip disconnect divide drag drain draw drive drop dry dump empty erase fasten feed fetch fill flatten flip fold fry get give grab grasp "
    "grate grind grip hammer hand hang hold insert iron join knead lay leave lift load lock loosen lower make mash measure mix mount move open pack paint paste peel pick pinch place plug "
    "polish position pour press process pull pump push put raise reach release remove replace reposition rinse rip roll rotate rub saw scoop scrape scratch screw scrub seal season secure "
    "separate set sew shake sharpen shift slice slide smooth snap soak spin split spray spread spread squeeze stack staple steady stick stir stitch store straighten stretch string strip support "
    "swap switch take tap tape tear throw tie tighten tilt toss transfer transport trim turn twist unfold unlock unplug unroll unscrew untie unwrap use wash weigh whisk wind wipe wrap write zip "
) | REJECTED_VERBS | STABILIZING | TRANSPORT | GENERIC_VERBS
#: Irregular forms of those.
IRREGULAR = {
    form: base
    for base, forms in {
        "bend": "bent", "bite": "bit bitten", "blow": "blew blown", "break": "broke broken", "bring": "brought", "build": "built", "catch": "caught", "draw": "drew drawn", "drive": "drove driven",
        "feed": "fed", "feel": "felt", "get": "got gotten", "give": "gave given", "grind": "ground", "hang": "hung", "hold": "held", "keep": "kept", "lay": "laid", "leave": "left", "make": "made",
        "see": "saw seen", "sew": "sewn", "shake": "shook shaken", "show": "shown", "slide": "slid", "spin": "spun", "stick": "stuck", "string": "strung", "sweep": "swept", "take": "took taken",
        "tear": "tore torn", "throw": "threw thrown", "tie": "tying", "wind": "wound", "write": "wrote written", "untie": "untying",
    }.items()
    for form in forms.split()
}
