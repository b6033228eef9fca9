"""Word lists. Results depend on each entry, so they stand as they are defined."""

HEDGES = {'uncertainty': ['i think', 'i believe', 'it seems', 'it appears', 'arguably', 'it depends', 'in my opinion', "i'd suggest", "i'd recommend"],
 'caveat_softener': ['however', 'that said', 'that being said', 'on the other hand', "it's worth noting", "it's important to note", 'keep in mind',
                     'to be fair', 'generally speaking', 'in general'],
 'epistemic': ['might', 'could', 'may', 'perhaps', 'possibly', 'likely', 'unlikely', 'tends to']}

DISCLAIMERS = {'ai_self_reference': ["i'm an ai", 'as an ai', "i'm a language model", "i don't have personal", "i can't experience", "i don't have feelings",
                       "i don't have opinions"],
 'knowledge_disclaimer': ['as of my knowledge', 'as of my last', 'my training data', 'i may not have the latest', "i don't have access to"],
 'safety_professional': ['consult a professional', 'consult a doctor', 'this is not medical advice', 'this is not financial advice',
                         'not a substitute for professional', 'seek professional'],
 'hedge_disclaimer': ["i'm not sure", "i'm not certain", 'i could be wrong', "don't quote me"]}

TRACKED_OPENERS = ['I', 'The', 'Here', 'Sure', 'Yes', 'No', 'That', 'This', 'To', 'It']

INSTRUCTIONS = {'step_by_step': ['step by step', 'step-by-step'],
 'conciseness': ['be concise', 'keep it short', 'briefly', 'in brief'],
 'simplification': ['explain like', 'eli5', 'simple terms', 'in layman'],
 'detail': ['be specific', 'be detailed', 'in detail', 'elaborate'],
 'formatting': ['list', 'bullet points', 'numbered list'],
 'examples': ['example', 'for instance', 'give me an example']}

ROLES = ['act as', 'you are a', "pretend you're", "imagine you're", 'as a', 'role of']

CONSTRAINTS = ["don't", 'do not', 'avoid', 'never', 'without', 'only', 'just', 'must', 'always', 'make sure']

CONTEXTS = ['here is', "here's", 'attached', 'below is', 'the following', 'context:', 'background:', 'for context', 'fyi']

POLITENESS_WORDS = ['please', 'thanks', 'thank you', 'sorry', 'appreciate', 'would you', 'could you', 'mind if']

THANKS = ['thanks', 'thank you', 'perfect', 'great', 'got it', 'that works', 'awesome', 'appreciate', 'wonderful', 'excellent', 'nice', 'cheers']

CORRECTIONS = ['actually', "that's wrong", "that's not right", "that's incorrect", 'i meant', 'no,', 'no.', 'nope', "that's not what"]

POSITIVE = ['good', 'great', 'excellent', 'wonderful', 'fantastic', 'amazing', 'awesome', 'perfect', 'beautiful', 'brilliant', 'outstanding', 'superb',
 'terrific', 'delightful', 'pleasant', 'positive', 'happy', 'glad', 'love', 'enjoy', 'appreciate', 'helpful', 'useful', 'valuable', 'effective',
 'successful', 'benefit', 'improve', 'enhance', 'strengthen', 'support', 'encourage', 'exciting', 'interesting', 'impressive', 'remarkable',
 'exceptional', 'innovative', 'creative', 'elegant', 'efficient', 'reliable', 'convenient', 'flexible', 'robust', 'powerful', 'insightful', 'clear',
 'straightforward', 'intuitive', 'comprehensive', 'thorough', 'well', 'best', 'better', 'advantage', 'opportunity', 'progress', 'growth',
 'achievement', 'accomplishment', 'reward', 'definitely', 'absolutely', 'certainly', 'fortunately', 'thankfully', 'recommended', 'ideal', 'optimal',
 'preferable', 'favorable']

NEGATIVE = ['bad', 'terrible', 'awful', 'horrible', 'poor', 'worst', 'wrong', 'fail', 'failure', 'error', 'mistake', 'problem', 'issue', 'bug', 'broken',
 'crash', 'damage', 'harm', 'dangerous', 'risky', 'threat', 'vulnerability', 'weakness', 'difficult', 'complex', 'complicated', 'confusing',
 'unclear', 'unfortunately', 'sadly', 'however', 'but', 'although', 'warning', 'caution', 'concern', 'worry', 'anxiety', 'frustrating', 'annoying',
 'disappointing', 'inadequate', 'insufficient', 'lacking', 'missing', 'limited', 'restrict', 'impossible', 'unable', 'cannot', 'never', 'nothing',
 'expensive', 'costly', 'slow', 'delay', 'obstacle', 'drawback', 'disadvantage', 'downside', 'negative', 'worse', 'harder', 'painful', 'struggle',
 'conflict', 'challenge', 'deprecated', 'obsolete', 'outdated', 'incompatible']

NEGATORS = ['not', 'no', 'never', 'neither', 'nor', "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", 'cannot', "shouldn't", "isn't", "aren't",
 "wasn't", "weren't", "haven't", "hasn't"]

POLITENESS_SUBSTRINGS = ["please", "thanks", "thank you", "sorry", "could you", "would you"]

CONTRACTIONS = (
    "don't|can't|i'm|it's|that's|what's|won't|didn't|isn't|aren't|wasn't|weren't|wouldn't|couldn't|shouldn't|hasn't|haven't|hadn't|he's|she's|we're|they're|you're|"
    "i've|we've|they've|i'll|we'll|they'll|you'll|he'll|she'll|let's|there's|who's"
)
IMPERATIVES = (
    "write|create|fix|show|make|build|generate|explain|tell|give|find|list|help|add|remove|update|change|convert|translate|summarize|describe|compare|analyze|design|"
    "implement|define|suggest|recommend|provide|calculate|solve|debug|refactor|optimize|review|check|test|run|set|use|try|do"
)
REQUESTS = (
    "can you|could you|would you|how do i|how can i|is it possible|what is|what are|what does|what do|how does|how do|why does|why do|is there|are there|do you|will you|shall we"
)
CONTEXT_OPENERS = "here is|here's|context:|background:|for context|the following"
EMOTICON = r"(?:[:;][-']?[)(DPp/\\\\|oO3><])|(?:<3)|(?:xD|XD)"
STOPWORDS = (
    "the is and of to a in for it that this with on as be at by an or not are was but from have has had do does did will would can could should may might "
    "i you we they he she my your our their its me us him her them"
).split()
#: Markdown marks counted per text line or pair.
FORMATS = {
    "headers": r"(?m)^#{1,6}\s",
    "bullet_points": r"(?m)^[\-\*]\s",
    "numbered_lists": r"(?m)^\d+\.\s",
    "code_blocks": r"```",
    "bold": r"\*\*[^*]+\*\*",
    "italic": r"(?<!\*)\*(?!\*)[^*]+\*(?!\*)",
}
