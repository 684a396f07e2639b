"""Set-based operators over document, claim, page and vector tables."""
