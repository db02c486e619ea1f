import re


def words(text, pattern=r"[^\x20\x09-\x0D]+", lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(pattern, text)
