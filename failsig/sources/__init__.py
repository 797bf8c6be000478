"""Tables in and out: runs, artifacts, logs, source trees and the knowledge base."""
