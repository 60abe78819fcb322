"""Word lists and thresholds that detection results depend on."""

HARD_FILLERS = ["um", "umm", "uh", "uhh", "uhm", "er", "erm", "ah", "hmm", "mm", "mhm"]
SOFT_FILLERS = ["like", "so", "basically", "actually", "right", "okay", "yeah", "obviously", "essentially", "literally"]
STOP_WORDS = [
    "a", "an", "and", "the", "or", "but", "so", "of", "to", "in", "on", "at", "is", "it", "its", "we", "you", "i", "that", "this", "with", "for",
    "as", "be", "are", "was", "have", "has", "can", "will", "what", "if", "do", "our", "your", "they", "he", "she", "them", "there", "here", "from", "by", "not",
]
RHETORICAL = ["very", "really", "no", "yes", "never", "much", "many", "far"]
CONTRACTIONS = ["'ve", "'ll", "'re", "'d", "'m", "'s"]
SUFFIXES = [("'s", ""), ("s", ""), ("es", ""), ("ies", "y"), ("ed", ""), ("ing", "")]
FAULT_WEIGHTS = {"brand": 6.0, "stutter": 2.0, "filler": 1.5, "low_conf": 1.0}
FILLER_PHRASES = ["you can see here", "you know", "basically", "kind of", "sort of", "and so forth", "go ahead and", "i think", "what we'll do is", "we've got", "i've got"]
#: Words too small to count in script lines.
SCRIPT_STOP_WORDS = ["i", "i'm", "we", "you", "that", "which", "in", "for", "to", "on", "of", "is", "are", "and", "or", "but", "it", "this", "as", "at", "by", "with"]
NUMBER_WORDS = {
    0: "zero", 1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six", 7: "seven", 8: "eight", 9: "nine", 10: "ten", 11: "eleven", 12: "twelve",
    20: "twenty", 30: "thirty", 40: "forty", 50: "fifty", 100: "hundred",
}
