def fetch(url):
    return url, 200, "text/html", f"<p>{url}</p>".encode()
