"""Sources: tables read as frames, text and JSON forms."""
