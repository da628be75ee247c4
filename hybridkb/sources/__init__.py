"""Page sources: crawl over a site table, file trees, repository trees, HTTP fetch helpers."""
