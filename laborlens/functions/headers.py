"""Headers of sections in descriptions, by class. ``enrich.sections`` takes any such table."""

from __future__ import annotations

#: Classes in order of precedence, with what a header of the class begins with.
HEADERS: dict[str, list[str]] = {
    "requirements": [
        r"(?:basic |minimum )?(?:requirements|qualifications)", r"what you'?ll need(?: to succeed)?", r"what we'?re looking for", r"what you bring", r"you (?:should |must |will )?have", r"we'?re looking for someone",
        r"required(?: skills| experience| qualifications)?", r"must[- ]have(?:s)?", r"key skills", r"who you are", r"about you", r"your background", r"experience(?: required)?", r"skills (?:and|&) (?:experience|qualifications)", r"what you need",
        r"(?:an )?ideal candidate", r"your profile", r"your qualifications", r"your expertise", r"you'?re a (?:great |strong |good )?fit", r"what you'll bring", r"the right candidate", r"what we look for", r"what we require(?:d)?",
        r"you (?:may |might )?(?:be a good fit|thrive in this role) if", r"you should apply if", r".{5,60}\((?:requirements?|qualifications?|must[- ]haves?)\)", r"we'?d love to hear from you if", r"experiences? (?:might |may |could )?include", r"your story",
        r"we'?re excited if you have", r"skills? you'?ll need to bring", r"as our next .{0,40} you should", r"(?:licenses?|certifications?) required", r"technical skills", r"what success looks like", r"what you will need", r"job requirements?", r"position requirements?",
        r"what we expect from you", r"minimum requirements?", r"to be successful(?: in this role)?", r"to thrive in this role", r"the successful candidate", r"(?:core|key|required|essential|critical) competencies", r"essential criteria", r"candidates? must have",
        r"who we(?:'?re| are) looking for", r"what we need", r"we(?:'?re| are| were) looking for", r"what you will bring", r"you bring", r"your experience", r"our ideal candidate", r"candidate profile", r"what are we looking for", r"requisitos", r"core experience", r"role requirements?", r"who we need",
        r"background$", r"key success criteria", r"your skills and experience", r"you possess", r"candidate requirements?", r"minimum$", r"who should apply",
    ],
    "preferred": [
        r"(?:preferred|desired)(?: skills?| experience| qualifications?| background)?", r"nice[- ]to[- ]have", r"bonus(?: points)?", r"it'?s (?:great|nice|a plus) if", r"strong candidates", r"a\s+plus", r"extra credit", r"additional(?: desired)? (?:skills?|qualifications?)",
        r"even better if", r"ideally you", r"what (?:will|would|makes?) (?:you )?(?:make you )?stand out", r"what sets you apart", r".{5,60}\((?:preferred|desired|nice[- ]to[- ]haves?|nonessential|bonus)\)", r"(?:while )?not required,?.{0,30}(?:plus|bonus|added)", r"and extra credit if",
        r"would be (?:a plus|great|ideal) if", r"recommended qualifications?", r"strongly preferred", r"highly desired", r"additional differentiators?", r"advantageous", r"diferenciais",
    ],
    "responsibilities": [
        r"(?:key )?responsibilities", r"what you'?ll (?:do|be doing|work on|own|get to do)", r"in this role,? you", r"your (?:day[- ]to[- ]day|impact)", r"you will(?:\.\.\.)?", r"the (?:opportunity|impact you will have)", r"areas of focus", r"about the role", r"role overview",
        r"job description", r"position overview", r"a day in the life", r"your mission", r"what you'?ll achieve", r".{5,60}\(responsibilities\)", r"the role", r"about the job", r"your responsibilities", r"(?:job|position|role) summary", r"what you will do", r"job responsibilities",
        r"primary responsibilities", r"core responsibilities", r"essential (?:functions|duties|responsibilities)", r"duties (?:and|&) responsibilities",
    ],
    "about_company": [r"about (?:us|the company|the team|our company|our mission)", r"who we are", r"our (?:mission|vision|culture|values|story)", r"why (?:join|work)", r"the team", r"company overview", r"about this team"],
    "benefits": [r"(?:benefits|perks|compensation|total rewards)", r"what we offer", r"why you'?ll love", r"we offer", r"our benefits", r"salary", r"pay range"],
    "boilerplate": [
        r"equal\s*opportunity\s*(?:employer|employment)", r"\beeo\b", r"affirmative\s*action", r"(?:diversity|inclusion)\s*(?:and|&|,)\s*(?:equity|inclusion|belonging)", r"we\s*(?:do\s*not|don't)\s*discriminate", r"physical\s*(?:requirements?|demands?)", r"work(?:ing)?\s*(?:environment|conditions?|hours?|schedule)",
        r"(?:background|drug)\s*(?:check|screening|testing)", r"(?:job\s*applicant|candidate|applicant)\s*privacy\s*(?:notice|policy|statement)", r"privacy\s*(?:notice|policy|statement|rights?)", r"for\s*(?:ca|california|colorado|new\s*york)\s*residents?", r"ccpa", r"#li-",
    ],
}
#: What may stand before a header on its line.
BEFORE = r"^\s*(?:\:\w+\:\s*)*(?:here'?s\s+)?(?:[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]\s*)*(?:\*{1,2}|#{1,4})?\s*"
#: Fixed value: characters that a header's line may go on for.
AFTER = 60


def header(patterns: list[str]) -> str:
    """The pattern of a line that is a header of a class."""
    return f"(?i){BEFORE}(?:{'|'.join(patterns)})[^\\n]{{0,{AFTER}}}$"
