"""Sources and sinks: document files, chunk and vector stores, manifests, projects."""
