"""What is brought along from outside: the page model and models for single regions."""
