"""Sources and sinks: document files, positioned PDF text, web pages, book tables, text export."""
